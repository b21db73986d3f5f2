"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Three passes over the vectors: counts and sums, products of the centred entries, and the
covariance of what came out. Entries are whole numbers, so the sums are exact whatever the
partitioning is, and the covariance is rounded once. Its eigenvectors come from polar
decompositions: the orthogonal factor of a shifted covariance is the sign of its
eigenvalues and gives the projectors on both sides of the shift, which split the space in
two, until blocks of one dimension are left. Only matrices of dimension by dimension reach
the driver; the components go out with the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Numbers that a task works on at once.
BLOCK = 1 << 20
#: Larger entries have no whole number that a double holds: as not finite.
LARGEST = 2.0**52
#: Variances under this share of the trace are rounding.
TINY = 1e-14


# --- the spectral decomposition ------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley
    iteration: by QR while the weights are large, and then by Cholesky."""
    n = len(a)
    x = a / (np.linalg.norm(a) or 1.0)
    low, eye = 1e-16, np.eye(n)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        h = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))[0]
            new = (b / c) * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(eye + c * (x.T @ x))
            new = (b / c) * x + (h - b / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        new = (new + new.T) / 2
        low = min(1.0, low * (h + b * low**2) / (1 + c * low**2))
        moved, x = np.linalg.norm(new - x), new
        if low > 1 - 1e-15 and moved < 1e-12 * np.sqrt(n):
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first k columns span the eigenvectors of ``a`` above a shift;
    None where all eigenvalues are equal."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)  # of the eigenvalues
    if spread <= 4 * np.finfo(float).eps * np.abs(a).max():
        return None
    start = np.random.default_rng(n).standard_normal((n, n))  # the same in every run
    best = None
    for shift in (np.median(np.diag(a)), mean, *(mean + f * spread for f in (0.1, -0.1, 0.27, -0.27, 0.5, -0.5, 0.8, -0.8))):
        u = polar(a - shift * np.eye(n))
        k = int(round((n + np.trace(u)) / 2))
        if not 0 < k < n or np.linalg.norm(u @ u - np.eye(n)) > 1e-8:
            continue  # all on one side, or an eigenvalue at the shift
        p = (u + np.eye(n)) / 2
        basis = np.linalg.qr(p @ start[:, :k])[0]
        basis = np.linalg.qr(p @ basis, mode="complete")[0]
        left = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if best is None or left < best[0]:
            best = (left, basis, k)
        if left <= 100 * np.finfo(float).eps * np.linalg.norm(a):
            break
    return best and best[1:]


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, falling. Blocks are
    taken from the whole matrix in extended precision at every split, so that small
    eigenvalues do not carry the rounding of large ones."""
    n, wide, done = len(v), v.astype(np.longdouble), []

    def block(q: np.ndarray) -> np.ndarray:
        a = np.asarray(q.T @ (wide @ q), float)
        return (a + a.T) / 2

    open_ = [np.eye(n)] if n else []
    while open_:
        q = open_.pop()
        got = _split(block(q)) if q.shape[1] > 1 else None
        if got is None:
            done.append(q)
        else:
            basis, k = got
            open_ += [q @ basis[:, k:], q @ basis[:, :k]]
    q = np.concatenate(done, axis=1) if done else np.zeros((0, 0))
    e = np.array([float(x @ (wide @ x) / (x @ x)) for x in q.T.astype(np.longdouble)])
    order = np.argsort(-e, kind="stable")
    q = q[:, order]
    return e[order], q / np.linalg.norm(q, axis=0)


# --- passes over the vectors ---------------------------------------------------------------


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, entries) of the vectors of a column, as whole numbers end to end; the length
    of a vector that is dropped is -1."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.drop_null().flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ok = np.abs(flat) < LARGEST / SCALE  # not so for NaN
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    sizes[row[~ok]] = -1
    return sizes, np.floor(SCALE * flat[sizes[row] >= 0]).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, rows) of the vectors of length ``d``."""
    sizes, flat = _whole(column)
    valid = sizes >= 0
    flat = flat[np.repeat(sizes[valid] == d, sizes[valid])]
    at = np.flatnonzero(sizes == d)
    return at, flat.reshape(len(at), d)


def _exact(blocks: Iterator[np.ndarray], size: int) -> list[int]:
    """Sum of arrays of whole numbers in doubles or objects, without rounding."""
    total = np.zeros(size, object)
    for b in blocks:
        total += b.astype(np.int64).astype(object) if b.dtype == float else b
    return total.tolist()


def _slices(batches, d: int):
    for b in batches:
        step = max(1, BLOCK // max(1, d))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _sums(batches):
    """(length, position, count, sum) of the vectors of a partition; a position of -1 counts
    them, so that empty vectors count too."""
    count: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            sizes, flat = _whole(b.column(0).slice(at, 4096))
            sizes = sizes[sizes >= 0]
            row = np.repeat(sizes, sizes)
            for d in np.unique(sizes).tolist():
                rows = int((sizes == d).sum())
                x = flat[row == d].reshape(rows, d)
                x = x.sum(0) if not x.size or np.abs(x).max() < 1 << 50 else x.astype(object).sum(0)
                count[d], total[d] = count.get(d, 0) + rows, total.get(d, 0) + x.astype(object)
    out = [(d, i, Decimal(x)) for d, v in total.items() for i, x in enumerate([count[d], *v], -1)]
    cols = list(zip(*out)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.decimal128(38, 0))], names=["d", "i", "x"])


def _product(y: np.ndarray) -> np.ndarray:
    """y'y: in doubles where they hold it exactly, and of the other rows in whole numbers."""
    large = np.abs(y).max(axis=1) >= 1 << 16  # rows are 2^20 at most
    out = (y[~large].T.astype(float) @ y[~large].astype(float)).astype(np.int64).astype(object)
    if large.any():
        z = y[large].astype(object)
        out = out + z.T @ z
    return out


def _products(mid: np.ndarray):
    """(i, j, sum of the products of centred entries) of a partition, for i <= j."""
    d = len(mid)
    i, j = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d), object)
        for b in _slices(batches, d):
            x = _matrix(b.column(0), d)[1]
            if len(x):
                total += _product(x - mid)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in total[i, j]], pa.decimal128(38, 0))], names=["i", "j", "x"])

    return run


@dataclass
class Whitening:
    """n vectors of d entries with sums; components are columns, with eigenvalues e and the
    trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    e: np.ndarray
    trace: float

    @property
    def d(self) -> int:
        return len(self.sums)

    @property
    def sound(self) -> np.ndarray:
        """Components of which the variance is more than rounding."""
        return self.e > TINY * self.trace if self.trace > 0 else np.zeros(len(self.e), bool)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: in 64 bits where they hold it."""
        if self.n * float(np.abs(x).max(initial=0)) < 1 << 61 and float(np.abs(self.sums.astype(float)).max(initial=0)) < 1 << 61:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def project(self, z: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN for components without variance."""
        scale = np.where(self.sound, 1 / np.sqrt(np.where(self.sound, self.e, 1)), np.nan)
        return (z.astype(float) / self.n) @ self.components * scale


def fit_whitening(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """``vectors`` has one column of arrays. The dimension is the most frequent length (the
    largest of equally frequent ones); vectors of other lengths are left out. None without
    vectors."""
    sums = vectors.mapInArrow(_sums, "d int, i int, x decimal(38,0)").groupBy("d", "i").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    top = sums.filter("i = -1").orderBy(F.desc("x"), F.desc("d")).first()
    if top is None:
        return None
    d, n = top["d"], int(top["x"])
    s = np.array([int(r["x"]) for r in sums.filter((F.col("d") == d) & (F.col("i") >= 0)).orderBy("i").collect()] + [None], object)[:-1]
    mid = np.array([(2 * x + n) // (2 * n) for x in s], np.int64)
    rows = vectors.mapInArrow(_products(mid), "i int, j int, x decimal(38,0)").groupBy("i", "j").agg(F.sum("x").cast("decimal(38,0)").alias("x")).collect() if d else []
    off = s - n * mid.astype(object)
    v = np.zeros((d, d), np.longdouble)
    for i, j, x in rows:  # n^2 times the covariance is whole
        whole = n * int(x) - off[i] * off[j]
        v[i, j] = v[j, i] = np.longdouble(str(whole)) / np.longdouble(str(n * n))
    e, q = spectrum(v)
    return Whitening(n, s, q[:, :components], np.maximum(e[:components], 0), float(np.trace(v)))


def _spread(model: Whitening):
    """(k, l, number, sum or product) of the whitened vectors of a partition, about its own
    mean; l = -1: the mean, times the number."""
    k = int(model.sound.sum())

    def run(batches):
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for b in _slices(batches, model.d):
            x = _matrix(b.column(0), model.d)[1]
            if not len(x) or not k:
                continue
            w = model.project(model.apart(x))[:, :k]
            own = w.mean(0)
            w = w - own
            step = own - mean
            m2 += w.T @ w + np.outer(step, step) * n * len(x) / (n + len(x))
            mean = mean + step * len(x) / (n + len(x))
            n += len(x)
        i, j = (a.ravel() for a in np.indices((k, k + 1)))
        x = np.concatenate([m2 + n * np.outer(mean, mean), n * mean[:, None]], axis=1)[i, j] if k else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(np.where(j == k, -1, j), pa.int32()), pa.array(x, pa.float64())], names=["i", "j", "x"])

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of the whitened vectors minus the identity."""
    k = int(model.sound.sum())
    if not k:
        return None
    c = np.zeros((k, k + 1))
    for i, j, x in vectors.mapInArrow(_spread(model), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x")).collect():
        c[i, j] = x / model.n
    mean = c[:, k]
    return float(np.abs(c[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and whitened (array of doubles, null without variance), with deviation, the sum of
    (n * x - S)^2: null where a long cannot hold it, and deviation_wide, which can."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in _slices(batches, model.d):
            at, x = _matrix(b.column(1), model.d)
            z = model.apart(x)
            if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * model.d < 1 << 62:
                far = pa.array((z * z).sum(1), pa.int64())
                wide = far.cast(pa.decimal128(38, 0))
            else:
                sums = [int(s) for s in (z.astype(object) ** 2).sum(1)]
                far = pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())
                wide = pa.array([Decimal(s) if s < 10**38 else None for s in sums], pa.decimal128(38, 0))
            w = model.project(z)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), far, wide, lists], names=["id", "deviation", "deviation_wide", "whitened"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, f"id {kind}, deviation long, deviation_wide decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)


def whitening(df: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each vector and component: id, component (from 1), n, deviation, whitened,
    explained, identity_error, deviation_wide.

    Vectors that are null or hold null or not finite entries are dropped, and those of
    another length than most; entries of 2^42 and more count as not finite. Repeated rows and
    ids, null ids too, stay as they are. Of a component without variance (a constant table,
    fewer vectors than components) whitened is null and explained 0; explained is null where
    nothing varies. An empty table gives no rows. Other columns are not read."""
    vectors = df.select(F.col(vec_col).alias("v"))
    model = fit_whitening(vectors, components)
    if model is None:
        model = Whitening(0, np.zeros(0, object), np.zeros((0, 0)), np.zeros(0), 0.0)
        df = df.filter("false")
    error = identity_error(vectors, model) if model.n else None
    share: Column = F.array(*[F.lit(float(e / model.trace) if s else 0.0) for e, s in zip(model.e, model.sound)]) if model.trace > 0 else F.array().cast("array<double>")
    rows = whiten(df, model, id_col, vec_col).select(id_col, "deviation", "deviation_wide", F.posexplode("whitened").alias("_k", "whitened"))
    return rows.select(
        id_col, (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("_k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_wide",
    )
