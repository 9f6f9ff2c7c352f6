"""Whitening of embeddings by their leading principal components, found by Jacobi-Davidson.

Entries become whole numbers x = floor(SCALE * c) + SHIFT, so that n, the sums S and
n * x - S are exact. The covariance V is never built: a product V b is a pass over the
centred rows, whose partial sums Spark adds up by dimension.
Block Jacobi-Davidson: Rayleigh-Ritz in a search space gives approximate pairs; those
whose residual is within TOLERANCE of the largest value are locked and projected out;
for all others wanted the correction equation, projected off the locked and the current
vectors, is solved by a few steps of MINRES, side by side, so that one pass serves them
all; the corrections widen the space. It ends when all residuals are in double
precision. A pass sends as many numbers to the driver as there are dimensions times
columns in a block, at any number of rows; the search space holds at most SPACE blocks.
Defined cases: a vector that is null, or holds a null, a NaN, an infinity or an entry
beyond LIMIT, is dropped, and so is one whose length is not the commonest (of equally
common ones: the greatest); null ids are kept, repeated rows each count; only directions
with variance (beyond ROUNDING of the largest) are components, so equal vectors or a
single one give no rows, as an empty table does; components of equal variance are any
unit vectors that span them; long vectors are read whole; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored

SCALE, SHIFT = 1024, 100_000
#: Largest |c|: x and its sums over 2^22 thousand million rows stay exact.
LIMIT = float(2**31)
COMPONENTS = 8
TOLERANCE, ROUNDING = 1e-13, 1e-12
#: Further pairs held beside those wanted, MINRES steps a correction, blocks in the search space, rounds at most.
SPARE, STEPS, SPACE, ROUNDS = 2, 3, 8, 1_000
#: Entries of a stored block of vectors.
BLOCK = 1 << 18

Product = Callable[[np.ndarray], np.ndarray]


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with `x`, the fixed-point entries (array of long), instead of the column; those that have none are dropped."""
    entry = F.transform(column, lambda c: c.cast("double"))
    good = F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) <= LIMIT))  # NaN is above all numbers
    rows = vectors.where(F.col(column).isNotNull() & good & (F.size(column) > 0))
    first = rows.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    # entries out of range have no x: Spark may work this out before it drops their rows
    x = F.transform(entry, lambda c: F.when(F.abs(c) <= LIMIT, F.floor(c * SCALE) + SHIFT))
    return rows.where(F.size(column) == (first["d"] if first else 0)).withColumn("x", x).drop(column)


class Fit(NamedTuple):
    """n rows, exact sums of x by dimension, and the fixed-point rows as a table of packed blocks."""

    n: int
    sums: list[int]
    blocks: DataFrame

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the whole numbers n * x - S."""
        return centred(x, self.n, self.sums)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """(n * x - S) / n; the difference is taken in whole numbers, with the sums cut to quotient and rest so that they fit."""
    quotient = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.float64)
    return (x - quotient).astype(np.float64) - rest / n


def fit(rows: DataFrame) -> Fit:
    """rows has x."""
    totals = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    if not totals:
        return Fit(0, [], rows)
    d = len(totals)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), max(1, BLOCK // d)):
                x = np.stack(f["x"].iloc[k : k + max(1, BLOCK // d)].to_list()).astype("<i8")
                yield pd.DataFrame({"m": [len(x)], "x": [x.tobytes()]})

    return Fit(totals[0]["n"], [int(r["s"]) for r in totals], stored(rows.select("x").mapInPandas(pack, "m long, x binary"), "vectors"))


def summed(fitted: Fit, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all centred blocks of part(block), a matrix of some height and `width` columns."""
    n, sums = fitted.n, fitted.sums

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for m, x in zip(f["m"], f["x"], strict=True):
                y = part(centred(np.frombuffer(x, dtype="<i8").reshape(m, len(sums)), n, sums))
                total = y if total is None else total + y
        if total is not None:
            yield pd.DataFrame({"at": np.arange(len(total))} | {f"c{j}": total[:, j] for j in range(width)})

    cols = [f"c{j}" for j in range(width)]
    found = fitted.blocks.mapInPandas(run, "at long, " + ", ".join(f"{c} double" for c in cols)).groupBy("at").agg(*(F.sum(c).alias(c) for c in cols)).collect()
    return np.array([[r[c] for c in cols] for r in sorted(found, key=lambda r: r["at"])]).reshape(-1, width)


def covariance_product(fitted: Fit) -> Product:
    """b -> V b for a block of columns b, by one pass over the rows."""

    def product(b: np.ndarray) -> np.ndarray:
        return summed(fitted, b.shape[1], lambda y: y.T @ (y @ b)) / fitted.n

    return product


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns that span what `new` adds to the bases, twice made orthogonal; those that add nothing go."""
    out = np.zeros((len(new), 0))
    size = np.linalg.norm(new, axis=0)
    for v in (new[:, size > 0] / size[size > 0]).T:
        before = 1.0
        for _ in range(3):
            for q in (*bases, out):
                v = v - q @ (q.T @ v)
            after = np.linalg.norm(v)
            if after < 1e-10 * before or after < 1e-14:
                break
            v, before = v / after, 1.0
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Product, theta: np.ndarray, b: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """For each column j: t with P (V - theta_j) P t near b_j, by `steps` of MINRES; the columns share their passes."""
    width = b.shape[1]
    x = np.zeros_like(b)
    old, v = np.zeros_like(b), project(b)
    beta = np.linalg.norm(v, axis=0)
    scale = np.where(beta > 0, beta, 1.0)
    v = v / scale
    alive, eta, beta = beta > 0, beta.copy(), np.zeros(width)
    c, c_old, s, s_old = (np.ones(width), np.ones(width), np.zeros(width), np.zeros(width))
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    for _ in range(steps):
        if not alive.any():
            break
        p = project(product(v) - v * theta)
        alpha = np.sum(v * p, axis=0)
        p = p - v * alpha - old * beta
        below = np.linalg.norm(p, axis=0)
        # Givens rotations of the tridiagonal column (beta, alpha, below)
        r3, r2, r1 = s_old * beta, s * alpha + c_old * c * beta, c * alpha - c_old * s * beta
        r0 = np.hypot(r1, below)
        ok = alive & (r0 > 0)
        safe = np.where(ok, r0, 1.0)
        c_old, c, s_old, s = c, np.where(ok, r1 / safe, 1.0), s, np.where(ok, below / safe, 0.0)
        new = np.where(ok, (v - w_old * r3 - w * r2) / safe, 0.0)
        w_old, w = w, new
        x = x + w * (c * eta) * ok
        eta = -s * eta
        alive = ok & (below > 1e-14 * np.abs(scale))
        old, v, beta = v, np.where(alive, p / np.where(below > 0, below, 1.0), 0.0), below
    return x


class Pairs(NamedTuple):
    """Eigenvalues, falling, unit eigenvectors as columns, the largest residual, and the passes and rounds it took."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int
    rounds: int


def jacobi_davidson(product: Product, d: int, wanted: int, seed: int = 1) -> Pairs:
    """The `wanted` largest eigenpairs of a symmetric d x d product, all residuals within TOLERANCE of the largest value."""
    passes = 0

    def counted(b: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(b)

    wanted, block = min(wanted, d), min(wanted + SPARE, d)
    locked, values, worst, top = np.zeros((d, 0)), np.zeros(0), 0.0, 0.0
    basis = orthonormal(np.random.default_rng(seed).standard_normal((d, block)))
    image = counted(basis)
    for rounds in range(1, ROUNDS + 1):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, mapped = basis @ turn, image @ turn
        top = max([top, *np.abs(theta[:1]), *values[:1]])
        left = mapped - ritz * theta
        size = np.linalg.norm(left, axis=0)
        whole = locked.shape[1] + basis.shape[1] >= d  # nothing is left outside of the space
        done = (size <= TOLERANCE * top)[: block - locked.shape[1]]
        # pairs lock from the largest on, so that none is passed over; one more shows that no larger one follows
        n = len(done) if done.all() else int(np.argmin(done))
        if n:
            worst = max(worst, float(size[:n].max()) / top if top else 0.0)
            locked, values = np.column_stack([locked, ritz[:, :n]]), np.concatenate([values, theta[:n]])
            ritz, mapped, theta, left = ritz[:, n:], mapped[:, n:], theta[n:], left[:, n:]
        if locked.shape[1] >= wanted or not top or (whole and not ritz.shape[1]):
            order = np.argsort(-values, kind="stable")[:wanted]
            return Pairs(values[order], locked[:, order], worst, passes, rounds)
        active = min(block - locked.shape[1], ritz.shape[1])
        if basis.shape[1] > SPACE * block and not whole:  # thick restart
            ritz, mapped, theta = ritz[:, : 2 * block], mapped[:, : 2 * block], theta[: 2 * block]
        now = np.column_stack([locked, ritz[:, :active]])

        def project(z: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            return z - now @ (now.T @ z)

        steps = minres(counted, theta[:active], -project(left[:, :active]), project, STEPS) if not whole else np.zeros((d, 0))
        new = orthonormal(steps, locked, ritz)
        if not new.shape[1] and not whole:  # the space stands still: another random direction
            new = orthonormal(np.random.default_rng(seed + rounds).standard_normal((d, 1)), locked, ritz)
        basis = np.column_stack([ritz, new])
        if whole:  # only roundoff is left in the image
            basis = orthonormal(basis, locked)
            image = counted(basis)
        else:
            image = np.column_stack([mapped, counted(new)])
    raise ArithmeticError(f"residuals above {TOLERANCE} after {ROUNDS} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, component, n, deviation (decimal), whitened, explained and identity_error for each vector that stays and each component."""
    rows = whole_numbers(vectors.select(key, column), column)
    fitted = fit(rows)
    n, sums, d = fitted.n, fitted.sums, len(fitted.sums)
    # keys travel as text: pandas would make floating-point numbers of whole ones beside nulls
    kind = vectors.schema[key].dataType
    schema = f"`{key}` string, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    trace = float(summed(fitted, 1, lambda y: np.array([[np.sum(y * y)]]))[0, 0]) / n if n else 0.0
    if not trace > 0:
        return rows.sparkSession.createDataFrame([], schema).withColumn(key, F.col(key).cast(kind))
    pairs = jacobi_davidson(covariance_product(fitted), d, components)
    k = int(np.sum(pairs.values > ROUNDING * pairs.values[0]))
    turn = pairs.vectors[:, :k] / np.sqrt(pairs.values[:k])
    moments = summed(fitted, k + 1, lambda y: np.column_stack([y @ turn, np.ones(len(y))]).T @ np.column_stack([y @ turn, np.ones(len(y))])) / n
    spread = moments[:k, :k] - np.outer(moments[:k, k], moments[:k, k])
    error = float(np.max(np.abs(spread - np.eye(k))))
    explained = pairs.values[:k] / trace

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        for f in frames:
            for at in range(0, len(f), max(1, BLOCK // d)):
                g = f.iloc[at : at + max(1, BLOCK // d)]
                x = np.stack(g["x"].to_list()).astype(np.int64)
                white = centred(x, n, sums) @ turn
                far = [Decimal(v) for v in deviations(x, n, sums)]
                for j in range(k):
                    yield pd.DataFrame({key: g[key], "component": np.int32(j + 1), "n": n, "deviation": far, "whitened": white[:, j], "explained": explained[j], "identity_error": error})

    return rows.withColumn(key, F.col(key).cast("string")).mapInPandas(run, schema).withColumn(key, F.col(key).cast(kind))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n * x - S)^2 of each row, exact at any size."""
    s = np.array(sums, dtype=object)
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**62:
        v = n * x - s.astype(np.int64)
        if len(sums) * int(np.abs(v).max(initial=0)) ** 2 < 2**63:
            return np.sum(v * v, axis=1).tolist()
    v = n * x.astype(object) - s
    return np.sum(v * v, axis=1).tolist()


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long (some millions of rows far from the mean) is null; `whiten` gives it whole."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
