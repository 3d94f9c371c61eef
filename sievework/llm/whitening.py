"""Embedding whitening by matrix-free block Lanczos.

Vectors are put on a grid of whole numbers, and each distinct one is taken once (the fit list).  Its size and sums give
exact deviations from the mean.  The covariance is never formed: a pass over the fit list gives its product with a block
of a few vectors, each task adding up centred rows, and tasks' sums are added in groups before the driver gets them.
Block Lanczos keeps an orthonormal basis on the driver (dimensions x MOST_BASIS at the utmost, whatever the rows),
orthogonalises each new block against all of it twice, takes a random direction where a block breaks down, solves the
projected problem, and ends once the residuals of all wanted pairs are small or the basis spans the space; a full basis
is thickly restarted from its best vectors.  The trace comes from the deviations, so shares need no further passes.

Defined cases: a row whose vector is null, empty, or holds a null or non-finite entry (or one of 2 ** 46 and more, which
the grid can't hold) is left out; so is one whose vector isn't of the length that most rows have (of equally many, the
longest); equal vectors count once in the fit and get equal results; null and equal vec_ids are kept row by row; there
are as many components as the covariance has positive eigenvalues, so none for one distinct vector; an empty table gives
an empty result; other columns are ignored.  Components of equal eigenvalues are any basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.store import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Vectors in a block, and in the basis of a long run before it is restarted.
BLOCK, MOST_BASIS = 16, 256
#: A pair is found once its residual is below this share of the largest eigenvalue.
RESIDUAL = 1e-13
#: Eigenvalues below this share of the largest one count as zero.
ZERO = 1e-12
#: Products of the covariance with a block, at most; the spaces of usual embeddings need a few.
MOST_PASSES = 500
#: Rows that a task multiplies at once.
ROWS = 4096


def on_grid(c: Column) -> Column:
    """Whole numbers floor(64 * c) + 1000000 of a vector; null if an entry can't be given one."""
    whole = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + SHIFT)
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 2.0**46))
    return F.when(F.coalesce(fine, F.lit(False)) & (F.size(c) > 0), F.when(fine, whole))


def gridded(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, x) of the rows that have a vector of the usual length."""
    known = rows.select(F.col(key).alias("vec_id"), on_grid(F.col(vector)).alias("x")).where("x is not null")
    lengths = known.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))  # a row a length
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return known.where(F.size("x") == (usual[0]["d"] if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<long> column whose lists are equally long."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def slabs(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part, matrix(part.column(part.schema.get_field_index(column)))


@dataclass
class Fit:
    """The fit list with its exact size and sums."""

    rows: DataFrame
    n: int
    sums: list[int]

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and rest of the mean, so that a difference to it loses no digit."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])


def fit_list(x: DataFrame) -> Fit:
    """Each vector once, stored, with sums: exact ones, as decimals of a task's whole numbers."""
    rows = stored(x.select("x").distinct(), "whitening-fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, m in slabs(batches):
            high, low = (m >> 24).sum(0), (m & 0xFFFFFF).sum(0)
            now = [(int(h) << 24) + int(w) for h, w in zip(high, low, strict=True)]
            total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
            n += len(m)
        if n:
            values = [Decimal(v) for v in [n, *total]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["dim", "total"])

    got = rows.mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).orderBy("dim").collect()
    return Fit(rows, int(got[0]["total"]), [int(r["total"]) for r in got[1:]]) if got else Fit(rows, 0, [])


def added(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """Sum of the arrays (all of one shape) that tasks make of their rows.  Tasks' arrays are added in about as many
    groups as a group has tasks, in their order, so neither a task nor the driver gets very many."""
    groups = max(1, round(rows.rdd.getNumPartitions() ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work(batches)
        if made is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part % groups], pa.int32()), pa.array([part], pa.int32()), pa.array([made.astype(np.float64).tobytes()], pa.binary())], names=["g", "part", "made"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        out = None
        for value in table.column("made"):
            m = np.frombuffer(value.as_py())
            out = m.copy() if out is None else out + m
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "made": pa.array([out.tobytes()], pa.binary())})

    got = rows.mapInArrow(run, "g int, part int, made binary").groupBy("g").applyInArrow(total, "g int, made binary").collect()
    made = [np.frombuffer(r["made"]) for r in sorted(got, key=lambda r: r["g"])]
    return np.sum(made, axis=0) if made else None


def covariance_times(fit: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the covariance with a block of vectors: one pass over the fit list."""
    whole, rest = fit.mean

    def times(block: np.ndarray) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
            out = None
            for _, m in slabs(batches):
                c = (m - whole) - rest
                made = c.T @ (c @ block)
                out = made if out is None else out + made
            return out

        return added(fit.rows, work).reshape(block.shape) / fit.n

    return times


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """Orthonormal columns that span what the block adds to the basis.  A column that adds nothing (breakdown) is put
    anew at random, as long as the space has room."""
    out = basis
    for v in block.T:
        floor = 1e-10 * scale
        while out.shape[1] < len(v):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > floor and left > 1e-10 * size:
                v = v / left
                v = v - out @ (out.T @ v)
                out = np.column_stack([out, v / np.linalg.norm(v)])
                break
            v, floor = rng.normal(size=len(v)), 0.0
    return out[:, basis.shape[1] :]


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, block: int = BLOCK, most_basis: int = MOST_BASIS, residual: float = RESIDUAL, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, eigenvectors as columns, passes) of the `wanted` largest pairs, by falling eigenvalue."""
    rng, wanted, block = np.random.default_rng(seed), min(wanted, d), min(block, d)
    most_basis = max(most_basis, 2 * wanted + 2 * block)
    basis, image, scale = np.zeros((d, 0)), np.zeros((d, 0)), 0.0
    new = orthonormal(rng.normal(size=(d, block)), basis, rng, 1.0)
    for passes in range(1, MOST_PASSES + 1):
        made = times(new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, made])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        scale = max(scale, abs(values[0]), 1e-300)
        vectors, images = basis @ turn, image @ turn
        enough = basis.shape[1] >= wanted
        off = np.linalg.norm(images[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0).max() if enough else np.inf
        if basis.shape[1] == d or off <= residual * scale:
            return values[:wanted], vectors[:, :wanted], passes
        following = made - basis @ (basis.T @ made)
        if basis.shape[1] + block > most_basis:  # thick restart: the best vectors stay, with their images
            basis, image = vectors[:, : wanted + block], images[:, : wanted + block]
        new = orthonormal(following, basis, rng, scale)
    raise ArithmeticError(f"eigenvectors not found in {MOST_PASSES} passes")


@dataclass
class Whitening:
    """Components of a fit: eigenvalues and unit eigenvectors (columns), and what a row needs to be projected."""

    n: int
    sums: list[int]
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float = 0.0
    identity_error: float = 0.0
    passes: int = 0

    def project(self, m: np.ndarray) -> np.ndarray:
        return (((m - self.whole) - self.rest) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, m: np.ndarray) -> list[int] | np.ndarray:
        """Sum over dimensions of (n * x - sums) ** 2, exactly: whole numbers of 64 bits where they suffice."""
        shift = np.array([s - w * self.n for s, w in zip(self.sums, self.whole.tolist(), strict=True)], dtype=object)
        far = int(np.abs(m - self.whole).max(initial=0) + 1) * self.n
        if far * far * m.shape[1] < 1 << 62:
            return ((self.n * (m - self.whole) - shift.astype(np.int64)) ** 2).sum(1)
        return [sum((self.n * int(a) - b) ** 2 for a, b in zip(r, shift, strict=True)) for r in m - self.whole]


def fitted(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the vectors; None without any."""
    fit = fit_list(x)
    if not fit.n:
        return None
    whole, rest = fit.mean
    d = len(fit.sums)
    values, vectors, passes = lanczos(covariance_times(fit), d, components)
    kept = values > ZERO * max(values[0], 0.0)
    w = Whitening(fit.n, fit.sums, whole, rest, values[kept], vectors[:, kept], passes=passes)

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        # the whitened rows' own mean is taken off, too, though it is zero but for rounding
        k, seen = len(w.values), 0
        products, sums, deviation = np.zeros((k, k)), np.zeros(k), 0
        for _, m in slabs(batches):
            p = w.project(m)
            products += p.T @ p
            sums += p.sum(0)
            deviation += sum(map(int, w.deviations(m)))
            seen += len(m)
        # the deviations' sum as a fraction of n squared: whole numbers until here
        return np.concatenate([products.ravel(), sums, [deviation / (w.n * w.n)]]) if seen else None

    got = added(fit.rows, work)
    k = len(w.values)
    mean = got[k * k : -1] / w.n
    w.trace = got[-1] / w.n
    w.identity_error = float(np.abs(got[: k * k].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    return w


WHITENED = "vec_id {id}, n bigint, deviation decimal(38,0), whitened array<double>"


def whiten(x: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, n, deviation and the whitened vector of every row, in one pass."""
    sent = x.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for part, m in slabs(batches):
            p = w.project(m)
            ends = np.arange(0, p.size + 1, max(1, p.shape[1])) if p.size else np.zeros(len(m) + 1)
            d = w.deviations(m)
            exact = pa.array(d).cast(pa.decimal128(38, 0)) if isinstance(d, np.ndarray) else pa.array([Decimal(v) for v in d], pa.decimal128(38, 0))
            columns = [part.column("vec_id"), pa.array([w.n] * len(m), pa.int64()), exact, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(p.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "n", "deviation", "whitened"])

    return x.select("vec_id", "x").mapInArrow(run, WHITENED.format(id=dict(x.dtypes)["vec_id"]))


def by_component(x: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component.  A deviation beyond a long is an error, never a wrong number."""
    w = fitted(x, components)
    kind = dict(x.dtypes)["vec_id"]
    if w is None:
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shares = F.array(*[F.lit(float(v / w.trace)) for v in w.values]) if len(w.values) else F.array().cast("array<double>")
    flat = whiten(x, w).select("vec_id", "n", F.col("deviation").cast("bigint").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    return flat.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(w.identity_error).alias("identity_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(gridded(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
