"""Documents with every awkward case, and the shared session's tables."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *[T.StructField(c, T.StringType()) for c in ("_id", "_bad", "bucket", "keys", "rest", "component", "sig", "block", "y", "score", "vslot", "ws")],
    ]
)


def words(rng, n):
    return " ".join(rng.choice("alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()) + str(rng.randrange(40)) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(30, 300)) for _ in range(25)]
    shared = words(rng, 80)
    out = list(base)
    out += base[:6]  # exact copies
    for t in base[6:14]:  # near copies of different closeness
        w = t.split()
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{words(rng, 20)}\n{shared}\t{words(rng, 10)}" for _ in range(8)]  # a passage that many share
    out += [base[3] + " " + base[4], base[4][100:400], "Été " * 30 + base[5], "x" * 30000 + " tail", "ab " * 4000]
    out += ["", None, " ", "one", "two words", None, "", "\n\n", "É", "a b c d", "a b c d", "MIT", "日本語 テキスト " * 20]
    return out


def documents(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    full = [(i, t, "en", "src", None if t is None else len(t), *["x"] * 12) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def pairs_of(rows=None):
    return list(enumerate(texts())) if rows is None else rows
