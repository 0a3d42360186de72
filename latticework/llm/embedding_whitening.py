"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The distinct rows X (centred) stay distributed. A step takes v to u = Xv and on to X'u, each made orthogonal to all vectors of its side before; the driver
holds vectors of one row's length only: a left vector u is as long as the table, but it is X times a vector w of a row's length, so tasks make their entries of it from
their rows. The small bidiagonal matrix's singular values and vectors give the components and their deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latticework.functions.durable import discard, written_at

_EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    """A fit: ``n`` distinct rows, exact ``sums`` a dimension, unit ``components`` by falling ``values`` (eigenvalues of the covariance), its ``trace``, ``identity_error``."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * c)`` as long for each entry, doubled first; null where an entry is null or not finite. Values beyond a long stop at its ends."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of an Arrow list column as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """``(rows int, block binary)``: the vectors in blocks of at most some 4 MB."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], max(1, 4_000_000 // (8 * d))

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([x.astype("<i8").tobytes()], pa.binary())], names=["rows", "block"])

        for batch in batches:
            x = _rows(batch.column(0), d)
            for i in range(0, len(x), many):
                held.append(x[i : i + many])
                if sum(map(len, held)) >= many:
                    yield out()
                    held = []
        if held:
            yield out()

    return rows.mapInArrow(work, "rows int, block binary")


def _summed(blocks: DataFrame, d: int, of, size: int) -> np.ndarray:
    """The sum over all blocks of ``of(x)``, ``size`` numbers: added up in each task, then by place in Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for block in batch.column(0):
                total += of(np.frombuffer(block.as_py(), "<i8").reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "x"])

    found = blocks.select("block").mapInArrow(work, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["at"]] = r["x"]
    return out


def _exact_sums(blocks: DataFrame, d: int) -> list[int]:
    """Sums of whole numbers a dimension, beyond a long where need be."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_py(), "<i8").reshape(-1, d)
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(a) << 32) + int(b) for t, a, b in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d)), pa.array([str(t) for t in total])], names=["at", "x"])

    found = blocks.select("block").mapInArrow(work, "at long, x string").groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = [0] * d
    for r in found:
        out[r["at"]] = int(r["x"])
    return out


def _off(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``x`` made orthogonal to ``basis``, twice for full precision."""
    for _ in range(2 if basis else 0):
        b = np.array(basis)
        x = x - b.T @ (b @ x)
    return x


def bidiagonalise(product, d: int, locked: np.ndarray, wanted: int, good_enough, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors of X off the rows of ``locked``, the greatest first, at most ``wanted``.

    ``product(w, ws)`` is ``|Xw|^2``, the products of ``Xw`` with each ``X w_j``, and ``X'Xw``: one pass in which each row goes through Xw and X'u. ``good_enough(s, r)`` tells from the values
    and the bounds of their residuals whether to stop. Where an invariant space is used up, a new direction goes on.
    """
    vs: list[np.ndarray] = []
    ws: list[np.ndarray] = []  # u_j = X w_j
    zs: list[np.ndarray] = []  # z_j = X' u_j
    alphas: list[float] = []
    betas: list[float] = []
    fixed, scale = list(locked), 0.0
    v, beta = _off(rng.standard_normal(d), fixed), 0.0
    v /= np.linalg.norm(v)
    while len(vs) < d - len(fixed):
        w = v - sum((z @ v) * w_j for z, w_j in zip(zs, ws))  # Xw is off all u_j, as u_j . Xv = z_j . v
        norm2, overlap, z = product(w, ws)
        w, z = w - sum(o * w_j for o, w_j in zip(overlap, ws)), z - sum(o * z_j for o, z_j in zip(overlap, zs))  # once more
        alpha = float(np.sqrt(max(0.0, norm2 - sum(o * o for o in overlap))))
        scale = max(scale, alpha, beta)
        vs.append(v)
        if len(vs) > 1:
            betas.append(beta)
        if alpha > d * _EPS * scale:
            alphas.append(alpha)
            ws.append(w / alpha)
            zs.append(z / alpha)
            r = _off(zs[-1], fixed + vs)
        else:  # v is in the null space of what is left
            alphas.append(0.0)
            ws.append(np.zeros(d))
            zs.append(np.zeros(d))
            r = np.zeros(d)
        beta = float(np.linalg.norm(r))
        if beta <= d * _EPS * scale:
            beta, r = 0.0, _off(rng.standard_normal(d), fixed + vs)
        p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        residuals = beta * np.abs(p[-1, :wanted])
        if beta and len(s) >= wanted and good_enough(s[:wanted], residuals):
            break
        length = float(np.linalg.norm(r))
        if length <= d * _EPS:
            break
        v = r / length
    p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
    found = q[:wanted] @ np.array(vs)
    return s[:wanted], found / np.linalg.norm(found, axis=1, keepdims=True)


def _leading(product, d: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest singular values and right vectors, each as often as it occurs.

    One start vector shows one direction of a value that occurs several times, so sweeps off the found directions go on until they show nothing greater than the last one.
    """
    rng = np.random.default_rng(7)
    fine = lambda s, r: bool((r * s <= _EPS * s[0] ** 2).all())
    s, v = bidiagonalise(product, d, np.zeros((0, d)), min(wanted, d), fine, rng)
    while len(s) < d and s[0] > 0:
        clear = lambda t, r: bool(r[0] <= 1e-3 * t[0] and t[0] + r[0] < s[-1]) or bool(r[0] * t[0] <= _EPS * s[0] ** 2)  # noqa: B023, E731
        t, u = bidiagonalise(product, d, v, 1, clear, rng)
        if not len(t) or t[0] <= s[-1] * (1 + 1e-9):
            break
        s, v = np.append(s, t), np.vstack([v, u])
        order = np.argsort(-s, kind="stable")[:wanted]
        s, v = s[order], v[order]
    return s, v


def fit(vectors: DataFrame, vector_col: str = "embedding", wanted: int = 4, scale: int = 256) -> Whitening | None:
    """The whitening of the distinct vectors of ``floor(scale * c)``; None if there are none.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are rows of another length than most have (ties: the greater length). Components
    of no deviation (fewer distinct rows than ``wanted``, or dependent dimensions) are left out. One shuffle makes the rows distinct; they are written once, in blocks.
    A step is one pass over the blocks, of which the driver gets numbers in proportion to a row's length; there are at most as many steps as dimensions in a sweep.
    """
    spark = vectors.sparkSession
    usable = vectors.select(whole(F.col(vector_col), scale).alias("x")).where("x is not null")
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None
    d = lengths[0]["d"]
    blocks, made = written_at(_blocks(usable.where(F.size("x") == d).distinct(), d))
    n = blocks.agg(F.sum("rows")).first()[0]
    sums = _exact_sums(blocks, d)
    means = np.array([t / n for t in sums])

    def product(w: np.ndarray, ws: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        before = np.array(ws).reshape(len(ws), d).T

        def of(x: np.ndarray) -> np.ndarray:
            c = x - means
            u = c @ w
            return np.concatenate([[u @ u], before.T @ (c.T @ u), c.T @ u])

        out = _summed(blocks, d, of, 1 + len(ws) + d)
        return float(out[0]), out[1 : 1 + len(ws)], out[1 + len(ws) :]

    s, v = _leading(product, d, wanted)
    s, v = s[s > d * _EPS * max(s[0], 1)], v[s > d * _EPS * max(s[0], 1)]
    k, values = len(s), s**2 / n

    def check(x: np.ndarray) -> np.ndarray:
        c = x - means
        y = c @ (v / np.sqrt(values)[:, None]).T
        return np.concatenate([[np.sum(c * c)], y.sum(axis=0), (y.T @ y).ravel()])

    out = _summed(blocks, d, check, 1 + k + k * k)
    mean = out[1 : 1 + k] / n
    error = float(np.abs(out[1 + k :].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    discard(spark, [made])
    return Whitening(n, sums, v, values, float(out[0]) / n, error)


def whitened(vectors: DataFrame, model: Whitening | None, vector_col: str = "embedding", scale: int = 256, out_col: str = "whitened", deviation_col: str = "deviation") -> DataFrame:
    """The usable rows of ``vectors``, all columns, with ``out_col`` (array of double, one entry a component of ``model``) and ``deviation_col``.

    The deviation is the sum over dimensions of ``(n * x - S)^2``, exact, null where it is beyond a long. Rows that ``fit`` leaves out are left out, repeated rows stay. Without a model (no
    usable rows) the result is empty. Columns of the two new names mustn't be in ``vectors`` (ValueError). No shuffle; the model holds a few vectors.
    """
    if clash := {out_col, deviation_col} & set(vectors.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = StructType([*vectors.schema.fields, *StructType.fromDDL(f"`{out_col}` array<double>, `{deviation_col}` long").fields])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n, means = len(model.sums), model.n, model.means
    sums = np.array([t % 2**64 for t in model.sums], dtype=np.uint64)
    project = (model.components / np.sqrt(model.values)[:, None]).T
    x_col = "_x"
    while x_col in vectors.columns:
        x_col += "_"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(batch.num_columns - 1), d)
            y = (x - means) @ project
            with np.errstate(over="ignore"):
                gap = x.astype(np.uint64) * np.uint64(n % 2**64) - sums  # modulo 2^64, as is the sum of squares
                deviation = (gap * gap).sum(axis=1, dtype=np.uint64).astype(np.int64)
            size = np.square(n * (x - means)).sum(axis=1)
            columns = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel())), pa.array(deviation, pa.int64(), mask=size > 9.2e18)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], out_col, deviation_col])

    usable = vectors.withColumn(x_col, whole(F.col(vector_col), scale)).where(F.col(x_col).isNotNull() & (F.size(x_col) == d))
    return usable.mapInArrow(work, schema)
