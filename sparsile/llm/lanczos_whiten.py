"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers (``floor(scale * c) + offset``), and rows X are those integers less their column means.  A step
takes the right vector v to u = Xv and u back to Xᵀu, both summed over all rows in one distributed pass; lengths and
overlaps give the upper bidiagonal matrix B with X V = U B.  Left vectors have an entry per row and are never stored:
u = Xw for a short vector w, so a pass computes the entries of all earlier ones where the rows are.  Each new vector is
orthogonalised against all earlier ones, the left ones through sums of the same pass; where that takes away more than half
of it, the pass is repeated on what is left.  When a vector vanishes, the space is invariant and goes on from a fresh
direction, so equal variances are all found.  The singular values of B are the deviations (times the root of the
number of rows), and V times its right singular vectors the components.

Steps end when the wanted components are exact, after as many as there are dimensions at most.  Rows are packed once
into blocks of integers in the shared folder; a pass reads those.  The driver holds a few square matrices of the
dimension's size, whatever the number of rows.

Defined results: a row is left out if its vector is null, has a null or non-finite entry, an entry beyond
``LIMIT`` times 1 / scale, or another length than most vectors (of equally frequent lengths the longer; length 0 never counts).  Keys are carried as they are:
null keys and repeated rows give rows of their own.  Components without variance (a deviation below ``FLAT`` of the largest) do not
exist, so one row, equal rows and an empty table give no rows.  Of equal variances any basis of their space is taken.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsile.session import durable

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096
LIMIT = 2.0**52
FLAT = 1e-10
TINY = 1e-14
SEED = 20240229


def whole_numbers(column: pa.Array, dims: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * c)`` of the usable vectors of a list column, and which rows those are."""
    sized = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    at = np.flatnonzero(sized.to_numpy(zero_copy_only=False))
    entries = column.take(pa.array(at)).flatten().cast(pa.float64())
    scaled = np.floor(scale * entries.to_numpy(zero_copy_only=False).reshape(-1, dims))
    with np.errstate(invalid="ignore"):
        usable = (np.abs(scaled) <= LIMIT).all(axis=1)
    return scaled[usable].astype(np.int64), at[usable]


def _packed(dims: int, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                numbers, _ = whole_numbers(batch.column(0).slice(at, BLOCK_ROWS), dims, scale)
                if len(numbers):
                    narrow = np.abs(numbers).max() < 2**31
                    data = numbers.astype(np.int32 if narrow else np.int64).tobytes()
                    yield pa.RecordBatch.from_pydict({"data": [data], "narrow": pa.array([bool(narrow)]), "n": pa.array([len(numbers)], pa.int64()), "sums": [numbers.sum(axis=0).tolist()]})

    return pack


def _summed(blocks: DataFrame, dims: int, width: int, products: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of ``products``, which takes the rows of a block to ``width`` numbers.  Tasks send one row each."""

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for data, narrow in zip(batch.column(0), batch.column(1)):
                rows = np.frombuffer(data.as_buffer(), np.int32 if narrow.as_py() else np.int64).reshape(-1, dims)
                total += products(rows.astype(np.float64))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width)), "x": pa.array(total)})

    sums = blocks.select("data", "narrow").mapInArrow(one_pass, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(width)
    for r in sums.collect():  # ``width`` rows
        out[r["at"]] = r["x"]
    return out


@dataclass(frozen=True)
class Whitening:
    """What the fit found: components in columns, their variances, and the sums of all rows."""

    n: int
    sums: np.ndarray  # of floor(scale * c), without the offset
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    scale: int = SCALE


def _apart_from(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):  # twice is enough
        for b in basis:
            v = v - (b @ v) * b
    return v


def bidiagonalise(step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(components in columns, singular values) of X, given ``step``: (W, t) to (Xᵀq, Uᵀq, q·q) with U = XW and q = Xt."""
    random = np.random.default_rng(SEED)

    def fresh(basis: list[np.ndarray]) -> np.ndarray:
        while True:
            v = _apart_from(random.standard_normal(dims), basis)
            if np.linalg.norm(v) > 1e-6:
                return v / np.linalg.norm(v)

    right, left, images = [fresh([])], np.zeros((dims, 0)), np.zeros((dims, 0))
    alphas: list[float] = []
    betas: list[float] = []
    largest = 0.0
    while True:
        t = right[-1] - (betas[-1] * left[:, -1] if betas else 0.0)
        for _ in range(3):
            image, overlap, square = step(left, t)
            t, image = t - left @ overlap, image - images @ overlap
            rest = square - overlap @ overlap
            if rest > 0.5 * square:
                break
        alpha = float(np.sqrt(max(rest, 0.0)))
        largest = max(largest, alpha)
        if alpha <= TINY * largest or rest <= 0.5 * square:  # nothing new is left of u
            alpha, t, image = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            t, image = t / alpha, image / alpha
        left, images = np.column_stack([left, t]), np.column_stack([images, image])
        alphas.append(alpha)
        k = len(right)
        if k == dims:
            break
        v = _apart_from(image - alpha * right[-1], right)
        beta = float(np.linalg.norm(v))
        largest = max(largest, beta)
        small = np.diag(alphas) + np.diag(betas, 1)
        if wanted < k and beta > TINY * largest:
            u, sigma, _ = np.linalg.svd(small)
            if (beta * np.abs(u[-1, :wanted]) <= TINY * sigma[0]).all():
                break
        if beta <= TINY * largest:
            beta, v = 0.0, fresh(right)
        else:
            v = v / beta
        betas.append(beta)
        right.append(v)
    _, sigma, turned = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    return (np.column_stack(right) @ turned.T)[:, :wanted], sigma[:wanted]


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The whitening of a table's vectors, or None if there is none usable."""
    column = vectors.select(F.col(vector).alias("v"))
    lengths = column.select(F.size("v").alias("d")).filter("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return None
    dims = lengths["d"]
    blocks = durable(column.mapInArrow(_packed(dims, scale), "data binary, narrow boolean, n long, sums array<long>"), "blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    sums = np.zeros(dims, dtype=np.int64)
    for r in blocks.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # a row per dimension
        sums[r["at"]] = r["x"]
    mean = sums / n

    def step(left: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        k = left.shape[1]

        def products(rows: np.ndarray) -> np.ndarray:
            rows = rows - mean
            q = rows @ t
            return np.concatenate([rows.T @ q, (rows @ left).T @ q, np.zeros(dims - k), [q @ q]])

        out = _summed(blocks, dims, 2 * dims + 1, products)
        return out[:dims], out[dims : dims + k], float(out[-1])

    trace = float(_summed(blocks, dims, dims, lambda rows: ((rows - mean) ** 2).sum(axis=0)).sum() / n)
    found, sigma = bidiagonalise(step, dims, min(components, dims))
    real = sigma > FLAT * max(sigma[0], 1e-300)
    found, variances = found[:, real], sigma[real] ** 2 / n
    k = len(variances)

    def moments(rows: np.ndarray) -> np.ndarray:
        white = ((rows - mean) @ found) / np.sqrt(variances)
        return np.concatenate([(white.T @ white).ravel(), white.sum(axis=0)])

    error = 0.0
    if k:
        sent = _summed(blocks, dims, k * k + k, moments)
        means = sent[k * k :] / n
        error = float(np.abs(sent[: k * k].reshape(k, k) / n - np.outer(means, means) - np.eye(k)).max())
    return Whitening(n, sums, found, variances, trace, error, scale)


def deviations(numbers: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of (n x - S)² of each row; null where 64 bits do not hold one."""
    rough = ((n * numbers.astype(np.float64) - sums) ** 2).sum(axis=1)
    if len(rough) and rough.max() > 2.0**62:
        exact = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in numbers]
        return [x if x < 2**63 else None for x in exact]
    return ((n * numbers - sums) ** 2).sum(axis=1).tolist()


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
    model = fit(vectors, vector, components, scale)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    if model is None or not len(model.variances):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    dims, k = model.components.shape

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                numbers, used = whole_numbers(part.column(1), dims, model.scale)
                m = len(numbers)
                white = ((numbers.astype(np.float64) - model.sums / model.n) @ model.components) / np.sqrt(model.variances)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(used)).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(numbers, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(white.ravel()),
                    pa.array(np.tile(model.variances / model.trace, m)), pa.array(np.full(m * k, model.identity_error))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)
