"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Four kinds are found by their form: e-mail addresses, IP addresses, card and phone numbers.  Each value of one is a
protected entity.  A term (a folded word) that stands near an entity, WINDOW words before or behind, may reveal it;
how much, the corpus tells: with N documents, df(c) of them with entity c, df(t) with term t anywhere and df(c, t) with
t near c, the term discloses PMI(c; t) = log2(N df(c, t) / (df(c) df(t))) of the entity's IC(c) = log2(N / df(c)) bits.
Near an entity of which it discloses a share of REMOVE or more a term is removed, from GENERALISE on it is replaced by
its class.  SUPPORT different texts must show a pair; copies of one text are one text, but all count as documents.

One pass finds entities and the words near them (texts without any need no more); their counts are aggregates of a
few rows a mention.  A second pass counts the documents of the terms that are candidates.  Up to BROADCAST_TERMS their
hashes are sent to all tasks; beyond that all words are counted and joined, with the same result.  Terms and entities
are told apart by 64-bit hashes, texts by MD5.

Defined cases: a null or empty text has no spans; a very long text is looked at whole, its mentions in slices; rows with
equal doc_id, and those without one, are judged each by its own text; equal texts have equal spans; an empty table gives
an empty result; other columns are carried along by `sanitise` and ignored else.  A term's share is 1 where its entity
is in all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import textops as tx
from sievework.llm.store import stored

KINDS = ["email", "ip", "card", "phone"]
ADDED = "term"
WINDOW = 8
SUPPORT = 2
GENERALISE, REMOVE = 0.75, 0.9
BROADCAST_TERMS = 1_000_000
#: Rows of found spans up to which they are sent to all tasks by `sanitise` (16 bytes of digest and a few spans each).
BROADCAST_TEXTS = 200_000
#: Mentions in a row of the found ones.
SLICE = 1000

#: The forms of the four kinds, with what their matches must hold.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_HINT = np.zeros(256, bool)
_HINT[list(b"@0123456789")] = True

Spans = list[tuple[int, int]]


def emails(text: str) -> Spans:
    """From each @ to both sides: a run of letters before it is looked at once, however long it is."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            out.append((start, done))
        at = text.find("@", done)
    return out


def addresses(text: str) -> Spans:
    """Four parts at a time of each chain of numbers and dots."""
    out = []
    for m in DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def cards(text: str) -> Spans:
    return [m.span() for m in DIGITS.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> Spans:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]


FINDERS: list[Callable[[str], Spans]] = [emails, addresses, cards, phones]


def entity(kind: int, value: str) -> int:
    """Name of a protected value: letters folded, numbers by their digits."""
    value = value.lower() if kind < 2 else only_digits(value)
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


FOUND = "doc_id {id}, digest binary, slice int, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, mentions array<struct<c:bigint,terms:array<struct<t:bigint,s:int,e:int>>>>"
_MENTIONS = pa.list_(pa.struct([("c", pa.int64()), ("terms", pa.list_(pa.struct([("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])))]))


def near_words(raw: np.ndarray, text: str, spans: list[Spans], window: int) -> list[dict]:
    """For each mention its entity and the words near it; words within a span of any kind are none."""
    low = tx.LOWER[raw]
    s, e, _ = tx.words(tx.Texts(low, np.array([0, len(raw)])), tx.NOT_ALNUM)
    h = tx.span_hashes(low, s, e).view(np.int64)
    if len(raw) != len(text):  # byte places to code points
        point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        s, e = point[s], point[e]
    covered = sorted(x for kind in spans for x in kind)
    edge = np.zeros(len(text) + 1, np.int32)
    for a, b in covered:
        edge[a] += 1
        edge[b] -= 1
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    free = inside[e] == inside[s]
    s, e, h = s[free], e[free], h[free]
    out = []
    for kind, own in enumerate(spans):
        for a, b in own:
            i, j = int(np.searchsorted(e, a, "right")), int(np.searchsorted(s, b, "left"))
            at = [*range(max(0, i - window), i), *range(j, min(len(s), j + window))]
            out.append({"c": entity(kind, text[a:b]), "terms": [{"t": int(h[k]), "s": int(s[k]), "e": int(e[k])} for k in at]})
    return out


def found(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document (slice 0) with its counts and base spans, and one for each further slice of mentions."""
    id_type = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in tx.chunks(batch, "text"):
                hints = np.concatenate(([0], np.cumsum(_HINT[t.data])))[t.offsets]
                rows, digests, slices, counts, bases, mentions = [], [], [], [], [], []
                for i in range(len(t)):
                    spans: list[Spans] = [[], [], [], []]
                    near: list[dict] = []
                    if hints[i + 1] > hints[i]:
                        raw = t.doc(i)
                        text = raw.tobytes().decode()
                        spans = [f(text) for f in FINDERS]
                        if any(spans):
                            near = near_words(raw, text, spans, window)
                    digest = hashlib.md5(t.doc(i).tobytes(), usedforsecurity=False).digest() if near else None
                    base = ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in own)
                    for k in range(max(1, -(-len(near) // SLICE))):
                        rows.append(i)
                        digests.append(digest)
                        slices.append(k)
                        counts.append([len(x) for x in spans])
                        bases.append(base if k == 0 else None)
                        mentions.append(near[k * SLICE : (k + 1) * SLICE])
                numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(digests, pa.binary()), pa.array(slices, pa.int32()), *numbers, pa.array(bases, pa.string()), pa.array(mentions, _MENTIONS)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "slice", *[f"n_{k}" for k in KINDS], "base", "mentions"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, FOUND.format(id=id_type)), "private-found")


def document_counts(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(t, df_t): the documents that hold each of the terms, over all words of all texts."""
    n = terms.count()
    wanted = np.sort(np.array([r["t"] for r in terms.collect()], np.int64)) if n <= most else None
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        seen = np.zeros(len(wanted), np.int64) if wanted is not None else None
        for batch in batches:
            for _, t in tx.chunks(batch, "text"):
                low = tx.Texts(tx.LOWER[t.data], t.offsets)
                s, e, first = tx.words(low, tx.NOT_ALNUM)
                h = tx.span_hashes(low.data, s, e).view(np.int64)
                doc = tx.owner(first)
                if wanted is not None:
                    if not len(wanted) or not len(h):
                        continue
                    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    hit = wanted[at] == h
                    pairs = np.unique(doc[hit] * len(wanted) + at[hit])
                    seen += np.bincount(pairs % len(wanted), minlength=len(wanted))
                else:
                    # a document's words once: pairs in the order of hash, then document
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    keys, counts = np.unique(h[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["t", "n"])
        if wanted is not None:
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(seen[some])], names=["t", "n"])

    counts = docs.select("text").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("df_t"))
    return stored(counts if wanted is not None else counts.join(terms, "t", "left_semi"), "private-terms")


def disclosing(docs: DataFrame, base: DataFrame, support: int = SUPPORT, least: float = GENERALISE, most: int = BROADCAST_TERMS) -> DataFrame:
    """(digest, s, e, share): the terms of each text that give an entity near them away, and how much at most."""
    # copies of a text are one text with a count; its mentions are taken from one copy
    held = base.where("digest is not null")
    texts = held.where("slice = 0").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    slices = held.groupBy("digest", "slice").agg(F.any_value("mentions").alias("mentions"))
    flat = slices.select("digest", F.explode("mentions").alias("m")).select("digest", F.col("m.c").alias("c"), F.explode_outer("m.terms").alias("x"))
    flat = stored(flat.select("digest", "c", "x.t", "x.s", "x.e"), "private-mentions")
    pairs = flat.select("digest", "c", "t").distinct().join(texts, "digest")
    # a row without a term stands for its entity
    entities = flat.select("digest", "c").distinct().join(texts, "digest").groupBy("c").agg(F.sum("n").alias("df_c"))
    near = stored(pairs.where("t is not null").groupBy("c", "t").agg(F.sum("n").alias("df_ct"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support), "private-pairs")
    terms = stored(near.select("t").distinct(), "private-candidates")
    total = base.where("slice = 0").count()
    known = near.join(document_counts(docs, terms, most), "t").join(entities, "c")
    ic = F.log2(F.lit(total) / F.col("df_c"))
    pmi = F.log2(F.lit(total) * F.col("df_ct") / (F.col("df_c") * F.col("df_t")))
    # counts of terms whose hashes meet may be too large, never too small
    known = known.select("c", "t", F.when(ic > 0, F.least(pmi / F.when(ic > 0, ic), F.lit(1.0))).otherwise(1.0).alias("share")).where(F.col("share") >= least)
    hits = flat.join(known, ["c", "t"])
    return stored(hits.groupBy("digest", "s", "e").agg(F.max("share").alias("share")), "private-spans")


def spans(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(base, added): what `found` gives, and for each text with any the spans of its disclosing terms, by its digest."""
    base = found(docs)
    marked = disclosing(docs, base, support, least)
    added = marked.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("s", "e", "share"))).alias("added"))
    return base, stored(added, "private-added")


def listed(base: DataFrame, added: DataFrame) -> DataFrame:
    """A row for each document: counts, the base spans' digest and all spans as text."""
    terms = F.array_join(F.transform("added", lambda x: F.concat(F.lit(f"{ADDED}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
    heads = base.where("slice = 0").join(added, "digest", "left")
    return heads.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"))


def _class(word: str) -> str:
    return "[number]" if any(c in "0123456789" for c in word) else "[name]" if word[:1].isupper() else "[word]"


def sanitise(docs: DataFrame, support: int = SUPPORT, least: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The documents, all columns, without personal data: base spans become [kind], disclosing terms their class, or
    nothing from `remove` on."""
    base, added = spans(docs, support, least)
    texts = base.where("slice = 0 and digest is not null").groupBy("digest").agg(F.any_value("base").alias("base")).join(added, "digest", "left")
    texts = stored(texts.select(F.col("digest").alias("_digest"), F.col("base").alias("_base"), F.col("added").alias("_added")), "private-texts")
    small = texts.count() <= BROADCAST_TEXTS
    inner = [f"_{i}_{c}" for i, c in enumerate(("digest", "base", "added"))]
    right = texts.toDF(*inner)
    joined = docs.join(F.broadcast(right) if small else right, F.unhex(F.md5("text")) == F.col(inner[0]), "left").drop(inner[0])
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = []
            for text, own, more in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist(), batch.column(len(schema) + 1).to_pylist(), strict=True):
                marks = [(int(a), int(b), f"[{k}]") for k, a, b in (x.split(":") for x in (own or "").split(",") if x)]
                marks += [(m["s"], m["e"], "" if m["share"] >= remove else _class(text[m["s"] : m["e"]])) for m in more or []]
                done, pieces = 0, []
                for a, b, put in sorted(marks):
                    if a >= done:  # where two kinds overlap the first one's mark stands for both
                        pieces += [text[done:a], put]
                    done = max(done, b)
                out.append("".join([*pieces, text[done:]]) if marks else text)
            columns = [batch.column(i) for i in range(len(schema))]
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(schema)])

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(*spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))
