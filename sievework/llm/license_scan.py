"""Licence scans by a trained paragraph classifier (DataFrame functions only).

Every word of every text is looked at.  Words and pairs of words that the model knows (its grams, by 64-bit hash) are
found where they stand; runs of at least two different ones with at most GAP words between are passages, once within
each line and once across the lines of a paragraph (lines between blank ones), so that a wrapped notice is read whole.
Grams that the model doesn't know weigh nothing, so text without any can't be a notice and needs no score.

Multinomial logistic regression over a passage's grams gives each licence family, `unknown` (other licences) and
`other` (prose) a score.  It is trained on the driver from the fixed texts of licence_texts.  The margin of the best
family is calibrated on texts, and on whole families, that are left out of the fit: below an even chance of being
right the passage is `unknown`.  A prediction is confirmed if enough of the passage's word pairs occur in the family's
template texts.  A passage across lines stands for those of its lines if it's confirmed by WHOLE of its pairs, or if
none of them is confirmed.

Defined cases: a null or empty text has no passage; a very long text is one array of lines in one task; a gram counts
once a passage however often it is repeated; repeated rows each get a result; of families with equal scores the first
by name is taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.licence_texts import FRAMES, NAMES, NOTICES, OTHERS, STOP, UNKNOWN

#: Words between two grams of a passage, at most.
GAP = 6
CONFIRM, WHOLE = 0.5, 0.75
#: A pair that begins with an article says no more than its second word, and counts in no template.
ARTICLES = ("a", "an", "the")
WORD_GAP = r"[^\p{L}\p{N}.+]+|\.+(?=[^\p{L}\p{N}]|$)"
FAMILIES = [*sorted(NOTICES), "unknown", "other"]
KNOWN = len(NOTICES)
#: Bits of a hash that the first filter and the table of grams go by.
FILTER_BITS, TABLE_BITS = 16, 11
ROUNDS, RATE, MOMENTUM, SHRINK, FOLDS = 250, 0.5, 0.9, 1e-3, 4
#: Passages of families that the model doesn't know, among all notices: what calibration takes for granted.
UNKNOWN_SHARE = 0.1


def tokens(text: str) -> list[list[str]]:
    """Words of each line."""
    return [[x for x in regex.split(WORD_GAP, line) if x] for line in text.lower().split("\n")]


def _after(lines: list[list[str]], at: int, i: int) -> str:
    """The word behind the i-th of a line, on the next line too."""
    return lines[at][i + 1] if i + 1 < len(lines[at]) else (lines[at + 1][:1] or [""])[0] if at + 1 < len(lines) else ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hash_of(*words: str) -> int:
    """Spark's xxhash64 of some strings."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return _signed(h)


def grams_of(lines: list[list[str]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(line, place, gram): each word, and the word with the next one."""
    return [(at, i, g) for at, ws in enumerate(lines) for i, w in enumerate(ws) for g in ((w,), (w, _after(lines, at, i)))]


Hit = tuple[int, int, int]  # line, place in it, gram


def passages(sizes: list[int], hits: list[Hit], joined: bool) -> list[list[Hit]]:
    """Runs of hits within a line, or with joined within a paragraph; sizes are the lines' words."""
    out: list[list[Hit]] = []
    for k, (at, i, g) in enumerate(hits):
        before, j, _ = hits[k - 1] if k else (-2, 0, 0)
        near = i - j if at == before else sizes[before] - j + i if joined and at == before + 1 else GAP + 1
        if near > GAP:
            out.append([])
        out[-1].append((at, i, g))
    return [run for run in out if len({g for _, _, g in run}) > 1]


def extent(sizes: list[int], run: list[Hit]) -> int:
    """Words from the first to the last hit."""
    (a, i, _), (b, j, _) = run[0], run[-1]
    return sum(sizes[a:b]) + j - i + 1


@dataclass(frozen=True)
class Model:
    grams: list[tuple[str, ...]]
    weights: np.ndarray  # gram x class
    bias: np.ndarray
    slope: float
    offset: float  # of the calibration
    templates: np.ndarray  # gram x family: a pair of words of the family's texts

    @property
    def number(self) -> dict[tuple[str, ...], int]:
        return {g: k for k, g in enumerate(self.grams)}


def _texts() -> list[tuple[int, str]]:
    """(class, text): notices and clauses, short notices made of names and frames, and prose."""
    out = [(FAMILIES.index(f), t) for f in NOTICES for t in NOTICES[f]] + [(KNOWN, t) for t in UNKNOWN]
    # the names of a family take turns with the frames
    out += [(FAMILIES.index(f), frame.format(name)) for f in NAMES for i, name in enumerate(NAMES[f]) for j, frame in enumerate(FRAMES) if (i + j) % 2 == 0]
    return out + [(KNOWN + 1, t) for t in OTHERS]


def _vocabulary(texts: list[tuple[int, str]]) -> list[tuple[str, ...]]:
    stop = set(STOP)
    found = {g for k, text in texts if k <= KNOWN for _, _, g in grams_of(tokens(text))}
    return sorted(g for g in found if not stop.issuperset(g) and g[-1])


def _hits(lines: list[list[str]], number: dict) -> list[Hit]:
    return [(at, i, number[g]) for at, i, g in grams_of(lines) if g in number]


def _fit(kernel: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the examples and biases, by gradient descent; classes weigh the same."""
    truth = np.eye(len(FAMILIES))[y]
    share = truth.sum(0)
    each = (1 / np.maximum(share, 1))[y][:, None] * len(FAMILIES) / max(1, (share > 0).sum())
    kernel, each = kernel.astype(np.float32), each.astype(np.float32)
    a, bias = np.zeros(truth.shape, np.float32), np.zeros(len(FAMILIES), np.float32)
    step, lift = np.zeros_like(a), np.zeros_like(bias)
    for _ in range(ROUNDS):
        z = kernel @ (a + MOMENTUM * step) + (bias + MOMENTUM * lift)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - truth) * each
        step = MOMENTUM * step - RATE * (g + SHRINK * a)
        lift = MOMENTUM * lift - RATE * g.mean(0)
        a, bias = a + step, bias + lift
    return a.astype(float), bias.astype(float)


def margin(z: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Score of class k against all others together, as log odds."""
    rest = np.where(np.arange(z.shape[1]) == k[:, None], -np.inf, z)
    top = rest.max(1)
    return z[np.arange(len(z)), k] - top - np.log(np.exp(rest - top[:, None]).sum(1))


def _platt(m: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the chance of being right, by Newton steps."""
    w, x = np.zeros(2), np.stack([m, np.ones(len(m))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, x.T @ (weight * (right - p)) - 1e-3 * w)
    return float(f"{w[0]:.6g}"), float(f"{w[1]:.6g}")


def _pair(g: tuple[str, ...]) -> bool:
    return len(g) == 2 and g[0] not in ARTICLES


def _templates(number: dict, texts: list[tuple[int, str]]) -> np.ndarray:
    out = np.zeros((len(number), KNOWN), bool)
    for k, t in texts:
        if k < KNOWN:
            out[[number[g] for _, _, g in grams_of(tokens(t)) if _pair(g) and g in number], k] = True
    return out


@lru_cache(maxsize=1)
def train() -> Model:
    """Examples are the passages of all texts, whole and in their halves."""
    texts = _texts()
    grams = _vocabulary(texts)
    number = {g: k for k, g in enumerate(grams)}
    rows, y, entry = [], [], []
    for e, (k, text) in enumerate(texts):
        (ws,) = tokens(text)
        parts = [ws] if len(ws) < 10 else [ws, ws[: len(ws) // 2], ws[len(ws) // 2 :]]
        for p, part in enumerate(parts):
            for run in passages([len(part)], _hits([part], number), False):
                # half a clause without a word of its own says little
                if k == KNOWN + 1 or not p or len(run) >= 8:
                    rows.append(run)
                    y.append(k)
                    entry.append(e)
    x = np.zeros((len(rows), len(grams)))
    for r, run in enumerate(rows):
        x[r, [g for _, _, g in run]] = 1 / np.sqrt(2 * extent([], run))
    y, entry = np.array(y), np.array(entry)
    kernel = x @ x.T
    # what the fit says of texts left out, and of families left out, which it should take for unknown
    margins, right, strange = [], [], []
    for fold in range(2 * FOLDS):
        family = fold >= FOLDS
        out = (y % FOLDS == fold - FOLDS) & (y < KNOWN) if family else entry % FOLDS == fold
        a, bias = _fit(kernel[np.ix_(~out, ~out)], y[~out])
        z = kernel[np.ix_(out, ~out)] @ a + bias
        best = z.argmax(1)
        named = best < KNOWN
        margins.append(margin(z, best)[named])
        right.append((best == y[out])[named])
        strange.append(np.full(int(named.sum()), family))
    strange = np.concatenate(strange)
    weight = np.where(strange, UNKNOWN_SHARE / strange.mean(), (1 - UNKNOWN_SHARE) / (1 - strange.mean()))
    slope, offset = _platt(np.concatenate(margins), np.concatenate(right).astype(float), weight)
    a, bias = _fit(kernel, y)
    # as many digits as the literals below have, so that any scorer gives the same
    return Model(grams, np.array([[float(f"{v:.6g}") for v in r] for r in x.T @ a]), np.array([float(f"{v:.6g}") for v in bias]), slope, offset, _templates(number, texts))


def judge(model: Model, sizes: list[int], run: list[Hit]) -> tuple[str, float, float, bool]:
    """Family, chance, share of template pairs and confirmation of a passage: what scan() says, in plain Python."""
    own, norm = list(dict.fromkeys(g for _, _, g in run)), np.sqrt(2 * extent(sizes, run))
    z = np.array([[sum((model.weights[g, k] for g in own), 0.0) / norm + model.bias[k] for k in range(len(FAMILIES))]])
    k = int(z.argmax())
    overlap = sum(model.templates[g, k] for g in own) / max(1, len([g for g in own if _pair(model.grams[g])])) if k < KNOWN else 0.0
    chance = 1 / (1 + np.exp(-(model.slope * float(margin(z, np.array([k]))[0]) + model.offset)))
    family = FAMILIES[k] if k >= KNOWN or chance >= 0.5 else "unknown"
    return family, round(float(chance), 6), round(float(overlap), 6), bool(k < KNOWN and chance >= 0.5 and overlap >= CONFIRM)


# ---- the same as columns


def _literal(values, kind: str) -> Column:
    """A constant array column, folded into one literal."""
    return F.split(F.lit(",".join(values)), ",").cast(f"array<{kind}>")


def _bucket(h: int, bits: int) -> int:
    return (h % (1 << 64)) >> (64 - bits)


def _table(model: Model) -> tuple[Column, Column]:
    """Hashes of the grams, and their numbers, by the leading bits of the hash."""
    held: list[list[tuple[int, int]]] = [[] for _ in range(1 << TABLE_BITS)]
    for k, g in enumerate(model.grams):
        h = hash_of(*g)
        held[_bucket(h, TABLE_BITS)].append((h, k))
    nested = lambda j, kind: F.expr(f"array({','.join('array(' + ','.join(f'cast({x[j]} as {kind})' for x in b) + ')' if b else f'cast(array() as array<{kind}>)' for b in held)})")
    return nested(0, "decimal(20,0)").cast("array<array<bigint>>"), nested(1, "int")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and licences: an array of (paragraph, family, probability, overlap, confirmed), one for each passage that
    the classifier takes for a notice, in their order; paragraph is the line that it begins on, from 0.  No shuffle."""
    model = train()
    hashes, numbers = _table(model)
    first = {_bucket(hash_of(g[0]), FILTER_BITS) for g in model.grams}
    begins = _literal((str(int(i in first)) for i in range(1 << FILTER_BITS)), "boolean")

    # each step is a projection of its own, whose columns the next reads several times, so that it isn't inlined there
    split = lambda line: F.filter(F.split(line, WORD_GAP), lambda x: x != "")
    a = docs.select(F.col(key), F.transform(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n"), split).alias("w"))
    word = lambda at, i: F.get(F.get("w", at), i)
    after = lambda at, i: F.coalesce(word(at, i + 1), word(at + 1, F.lit(0)), F.lit(""))
    bucket = lambda h, bits: F.shiftrightunsigned(h, 64 - bits).cast("int")

    def begun(ws: Column, at: Column) -> Column:
        """Places of a line where a gram may begin."""
        some = F.filter(F.transform(ws, lambda x, i: F.when(F.get(begins, bucket(F.xxhash64(x), FILTER_BITS)), i)), lambda i: i.isNotNull())
        return F.transform(some, lambda i: F.struct(at.alias("at"), i.alias("i")))

    b = a.select(key, "w", F.flatten(F.transform("w", begun)).alias("near"))

    def looked(h: Column) -> Column:
        """Number of a gram, by its hash."""
        own = F.array_position(F.get(hashes, bucket(h, TABLE_BITS)), h).cast("int")
        return F.when(own > 0, F.get(F.get(numbers, bucket(h, TABLE_BITS)), own - 1))

    hashed = F.flatten(F.transform("near", lambda x: F.array(F.struct(x["at"], x["i"], F.xxhash64(word(x["at"], x["i"])).alias("h")), F.struct(x["at"], x["i"], F.xxhash64(word(x["at"], x["i"]), after(x["at"], x["i"])).alias("h")))))
    found = F.transform(hashed, lambda x: F.struct(x["at"].alias("at"), x["i"].alias("i"), looked(x["h"]).alias("g")))
    c = b.select(key, F.transform("w", F.size).alias("n"), F.filter(found, lambda x: x["g"].isNotNull()).alias("hits"))
    hit = lambda k: F.get("hits", k)

    def starts(joined: bool) -> Column:
        def cut(k: Column) -> Column:
            x, y = hit(k - 1), hit(k)
            near = F.when(x["at"] == y["at"], y["i"] - x["i"])
            if joined:
                near = near.when(x["at"] + 1 == y["at"], F.get("n", x["at"]) - x["i"] + y["i"])
            return (k == 0) | (near.otherwise(F.lit(GAP + 1)) > GAP)

        return F.when(F.size("hits") > 0, F.filter(F.sequence(F.lit(0), F.size("hits") - 1), cut)).otherwise(F.array().cast("array<int>"))

    d = c.select(key, "n", "hits", starts(False).alias("s1"), starts(True).alias("s2"))

    def runs(s: str, joined: bool) -> Column:
        def bounds(start: Column, k: Column) -> Column:
            return F.struct(start.alias("s"), (F.coalesce(F.get(s, k + 1), F.size("hits")) - 1).alias("e"))

        def run(x: Column) -> Column:
            a, b = hit(x["s"]), hit(x["e"])
            own = F.array_distinct(F.transform(F.sequence(x["s"], x["e"]), lambda k: hit(k)["g"]))
            between = F.when(a["at"] < b["at"], F.aggregate(F.sequence(a["at"], b["at"] - 1), F.lit(0), lambda t, k: t + F.get("n", k))).otherwise(F.lit(0))
            return F.struct(F.struct(a["at"].alias("at"), a["i"].alias("i")).alias("a"), F.struct(b["at"].alias("at"), b["i"].alias("i")).alias("b"), (between + b["i"] - a["i"] + 1).alias("n"), own.alias("g"))

        made = F.filter(F.transform(F.filter(F.transform(s, bounds), lambda x: x["s"] < x["e"]), run), lambda x: F.size(x["g"]) > 1)
        # across lines only what no single line holds
        return F.filter(made, lambda x: x["a"]["at"] < x["b"]["at"]) if joined else made

    e = d.select(key, runs("s1", False).alias("r1"), runs("s2", True).alias("r2"))
    columns = [_literal(map(repr, w_k), "double") for w_k in model.weights.T.tolist()]

    def scored(x: Column) -> Column:
        norm = F.sqrt((2 * x["n"]).cast("double"))

        def score(k: int) -> Column:
            return F.aggregate(x["g"], F.lit(0.0), lambda s, g: s + F.get(columns[k], g)) / norm + F.lit(float(model.bias[k]))

        return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["g"].alias("g"), F.array(*[score(k) for k in range(len(FAMILIES))]).alias("z"))

    f = e.select(key, F.transform("r1", scored).alias("r1"), F.transform("r2", scored).alias("r2"))
    masks = _literal([str(sum(1 << k for k in np.flatnonzero(r).tolist())) for r in model.templates], "bigint")
    pairs = _literal([str(int(_pair(g))) for g in model.grams], "int")

    def ranked(x: Column) -> Column:
        top = F.array_max(x["z"])
        best = (F.array_position(x["z"], top) - 1).cast("int")
        rest = F.filter(x["z"], lambda v, k: k != best)
        high = F.array_max(rest)
        m = top - high - F.log(F.aggregate(rest, F.lit(0.0), lambda s, v: s + F.exp(v - high)))
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["g"].alias("g"), best.alias("k"), m.alias("m"))

    def judged(x: Column) -> Column:
        k = x["k"]
        named = k < KNOWN
        met = F.size(F.filter(x["g"], lambda g: F.getbit(F.get(masks, g), F.least(k, F.lit(KNOWN - 1))) == 1))
        of = F.greatest(F.lit(1), F.aggregate(x["g"], F.lit(0), lambda s, g: s + F.get(pairs, g)))
        overlap = F.when(named, met / of).otherwise(F.lit(0.0))
        chance = 1 / (1 + F.exp(-(F.lit(model.slope) * x["m"] + F.lit(model.offset))))
        family = F.when(~named | (chance >= 0.5), F.get(F.array(*[F.lit(n) for n in FAMILIES]), k)).otherwise("unknown")
        return F.struct(
            x["a"].alias("a"), x["b"].alias("b"), family.alias("family"), F.round(chance, 6).alias("probability"), F.round(overlap, 6).alias("overlap"), (named & (chance >= 0.5) & (overlap >= CONFIRM)).alias("confirmed")
        )

    notices = lambda c: F.filter(F.transform(F.transform(c, ranked), judged), lambda x: x["family"] != "other")
    g = f.select(key, notices("r1").alias("n1"), notices("r2").alias("n2"))
    within = lambda y, x: (y["a"] >= x["a"]) & (y["b"] <= x["b"])
    wide = F.filter("n2", lambda x: x["confirmed"] & ((x["overlap"] >= WHOLE) | ~F.exists("n1", lambda y: y["confirmed"] & within(y, x))))
    h = g.select(key, "n1", wide.alias("n2"))
    kept = F.array_sort(F.concat(F.filter("n1", lambda y: ~F.exists("n2", lambda x: within(y, x))), "n2"))
    return h.select(key, F.transform(kept, lambda x: F.struct(x["a"]["at"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), x["overlap"].alias("overlap"), x["confirmed"].alias("confirmed"))).alias("licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_notices"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform(sure, lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"),
    )


def plain_scan(text: str | None) -> list[tuple[int, str, float, float, bool]]:
    """The licences of one text by plain Python, for tests and single texts."""
    model = train()
    lines = tokens(text or "")
    sizes, hits = [len(ws) for ws in lines], _hits(lines, model.number)
    named = []
    for joined in (False, True):
        runs = [r for r in passages(sizes, hits, joined) if not joined or r[0][0] < r[-1][0]]
        named.append([(r[0][:2], r[-1][:2], *j) for r in runs if (j := judge(model, sizes, r))[0] != "other"])
    single, across = named
    inside = lambda y, x: y[0] >= x[0] and y[1] <= x[1]
    across = [x for x in across if x[5] and (x[4] >= WHOLE or not any(y[5] and inside(y, x) for y in single))]
    kept = sorted([y for y in single if not any(inside(y, x) for x in across)] + across)
    return [(x[0][0], *x[2:]) for x in kept]
