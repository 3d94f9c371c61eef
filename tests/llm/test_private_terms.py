"""Personal data and disclosing terms against plain patterns and counts."""

import hashlib
import math
import random
import re

import pytest

from sievework.llm import private_terms as pt
from tests.conftest import SMALL
from tests.llm.fixtures import documents, pairs_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def right(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def base_of(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if right(k, m.group())]


def plain(texts, support=pt.SUPPORT, least=pt.GENERALISE):
    """Rows of the query, by counting documents."""
    near, holds, with_c, words_of = {}, {}, {}, []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_of(text)
        words = [(m.start(), m.end(), m.group().translate(FOLD)) for m in WORD.finditer(text.translate(FOLD))]
        words_of.append({w for _, _, w in words})
        free = [w for w in words if not any(w[0] < b and a < w[1] for _, a, b in base)]
        for k, a, b in base:
            value = text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            with_c.setdefault((k, value), set()).add(i)
            for s, e, w in [w for w in free if w[1] <= a][-pt.WINDOW :] + [w for w in free if w[0] >= b][: pt.WINDOW]:
                near.setdefault(((k, value), w), set()).add(i)
                holds.setdefault(i, []).append(((k, value), w, s, e))
    out = []
    n = len(texts)
    for i, text in enumerate(texts):
        base, added = base_of(text), set()
        for c, w, s, e in holds.get(i, []):
            both = near[c, w]
            if len({texts[j] for j in both}) < support:
                continue
            ic = math.log2(n / len(with_c[c]))
            pmi = math.log2(n * len(both) / (len(with_c[c]) * sum(w in x for x in words_of)))
            if (min(1, pmi / ic) if ic > 0 else 1) >= least:
                added.add((s, e))
        own = [f"{k}:{a}:{b}" for k, a, b in base]
        count = [sum(k == x[0] for x in base) for k in PATTERNS]
        out.append((*count, hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + [f"term:{s}:{e}" for s, e in sorted(added)])))
    return out


def given(df):
    return sorted(tuple(r)[1:] for r in df.collect())


CASES = [
    "a@b.c@d.e, x@y z@.com @q.r a.b+c%d@e-f.g.h.", "é@b.c ÉÉa_x@b-.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.3.255 1..2.3.4.5 1.2.3", "4111 1111-1111 1111, 4111111111111112 41111111111111110000",
    "+1 (017) 555-7713. +1 +12 +1-2345678 ++4412345678 9 +1" + " " * 50 + "x", "x" * 5000 + "@" + "y" * 5000, "1" * 30000, "1." * 8000, "+1" * 500, "a@" * 500 + "b.c", "@" * 300, "a.b@c.d" * 200,
]


def test_forms():
    rng = random.Random(4)
    alphabet = "ab9@@..+--() 12345é\n"
    texts = CASES[:5] + [c for c in CASES[5:] if len(c) < 3000] + ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(4000)]
    for t in texts:
        got = [(k, *x) for k, f in zip(pt.KINDS, pt.FINDERS, strict=True) for x in f(t)]
        assert got == base_of(t), t
    assert [len(f(CASES[6])) for f in pt.FINDERS] == [0, 0, 0, 0]


def corpus():
    rng = random.Random(9)
    common = "the of and to in is was for on with as by at from".split()
    some = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(400)}" for _ in range(n))
    texts = [some(rng.randrange(5, 60)) for _ in range(150)]
    for k in range(6):
        who = f"person{k}@mail.example.org"
        for j in range(k + 1):
            texts.append(f"{some(20)} Dr Zanzibar{k} of unit{k} {who.title() if j % 2 else who} lives nearby{k}, {some(20)}")
    texts += [f"{some(5)} call +1 (017) 555-77{k} {some(4)} 4111 1111 1111 1111 Éclair{k % 2}" for k in (13, 13, 14)]
    return [*texts, texts[151], texts[152], "", None, "Zanzibar0 alone", *CASES]


def test_counts_and_terms(spark):
    texts = corpus()
    got = pt.listed(*pt.spans(documents(spark, list(enumerate(texts))).repartition(3)))
    rows = sorted(((r["doc_id"], *tuple(r)[1:]) for r in got.collect()))
    want = plain(texts)
    assert [r[1:] for r in rows] == want
    assert sum("term:" in w[-1] for w in want) > 10
    looser = pt.listed(*pt.spans(documents(spark, list(enumerate(texts))), 1, 0.3))
    assert given(looser) == sorted(plain(texts, 1, 0.3))


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in pt.query(spark, SMALL).orderBy("doc_id").collect()] == plain([r["text"] for r in rows])


def test_terms_without_broadcast(spark):
    docs = documents(spark, list(enumerate(corpus())))
    base = pt.found(docs)
    one, other = (sorted(map(tuple, pt.disclosing(docs, base, most=m).collect())) for m in (pt.BROADCAST_TERMS, 0))
    assert one == other and one


def test_awkward(spark):
    assert pt.listed(*pt.spans(documents(spark, []))).count() == 0
    rows = [*pairs_of(), (None, "me@x.yz"), (3, "me@x.yz"), (3, None)]
    got = pt.listed(*pt.spans(documents(spark, rows)))
    assert got.count() == len(rows) and got.where("n_email = 1").count() == 2
    every = documents(spark, [(i, "me@x.yz is here") for i in range(4)] + [(9, "me@x.yz is there")])
    assert set(given(pt.listed(*pt.spans(every)))) == set(plain(["me@x.yz is here"] * 4 + ["me@x.yz is there"]))
    long_ = " ".join(f"word{i} user{i}@host.example.com" for i in range(3500))
    assert pt.listed(*pt.spans(documents(spark, [(1, long_), (2, long_ + " end")]))).where("n_email = 3500").count() == 2


def test_sanitise(spark):
    texts = ["Ask Quillon42 Bexley of bob@x.yz or 10.0.0.1 now", "We met Quillon42 Bexley bob@x.yz and +1 234 567 890 there", None, ""] + [f"Bexley or of we met ask now there and {i}" for i in range(2)] + [f"plain {i}" for i in range(40)]
    docs = documents(spark, list(enumerate(texts)))
    out = pt.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[2] is None and got[3] == "" and all(got[i] == texts[i] for i in range(4, len(texts)))
    assert "[email]" in got[0] and "[ip]" in got[0] and "[phone]" in got[1] and "bob" not in got[0] + got[1]
    assert "Quillon42" not in got[0] + got[1]
    classes = {r["text"] for r in pt.sanitise(docs, least=0.5, remove=2.0).where("doc_id < 2").collect()}
    assert all("[number] [name]" in t for t in classes)


@pytest.mark.parametrize("text", ["", "x", "a@b.c"])
def test_one_document(spark, text):
    assert given(pt.listed(*pt.spans(documents(spark, [(1, text)])))) == plain([text])
