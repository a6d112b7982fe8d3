"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred distinct vectors.

With X the matrix of those, a step is one job: its tasks multiply their rows by a direction (Xv) and the results by their
rows again (X'u), and what leaves a task is one vector of the embedding's dimension. The left vectors u, as long as the
corpus, are never stored: u = Xp for a p of that dimension, so that they are orthogonalised, like the right ones, against
all before them by sums of the p. The singular values and vectors of the small bidiagonal matrix give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.shared import arrow_batches, scope, stash, table

COMPONENTS = 16
#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Beside the largest singular value, a length below which a direction is taken for zero.
ZERO = 1e-12
#: Beside the largest, a residual up to which a singular vector counts as settled, where the steps are bounded.
SETTLED = 1e-13


def whole_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of ``embeddings`` whose vector has whole entries, with these as ``x``.

    Rows go whose vector is null or holds an entry that is null, not finite or, times ``SCALE``, beyond 2**53, and those
    of another length than the most frequent one (of several the longest).
    """
    good = lambda c: c.isNotNull() & (F.abs(F.coalesce(c.cast("double"), F.lit(float("nan")))) < 2.0**53 / SCALE)  # noqa: E731  false for what is not finite: NaN is the greatest
    kept = embeddings.where(F.col(vector).isNotNull() & F.forall(vector, good)).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long")))
    length = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).select("size")
    return kept.join(F.broadcast(length), F.size("x") == F.col("size"), "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(rows: DataFrame, sums: Callable[[np.ndarray], np.ndarray], width: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of ``x`` of ``sums`` of a block of them: one row of ``width`` numbers leaves a task."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = sums(_matrix(batch.column("x")))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["k", "v"])

    out = np.zeros(width, np.int64 if kind == "long" else np.float64)
    for r in rows.select("x").mapInArrow(parts, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


@dataclass
class Whitening:
    """``n`` distinct vectors of these sums; the components, as columns, with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, by whole numbers."""
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)


def bidiagonalise(product: Callable[[np.ndarray], tuple[np.ndarray, float]], size: int, total: float, want: int, steps: int | None = None, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of X, the largest first; ``product(p)`` gives X'Xp and the square of |Xp|.

    Where a chain ends (what it has reached is closed under X and X'), another begins with a direction outside, so that
    equal singular values are all found; it is over when the squares found leave nothing of ``total``, those of X. With
    ``steps`` fewer than ``size``, the ``want`` largest must have settled by then, or this raises.
    """
    random = np.random.default_rng(seed)
    right, left, images = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros((size, 0))  # v; p with u = Xp; X'u
    entries: list[tuple[int, int, float]] = []
    found = largest = beta = 0.0
    v: np.ndarray | None = None

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - right @ (right.T @ x)
        return x

    for step in range(size):
        if total - found <= ZERO * total:
            break
        if v is None:
            v, beta = apart(random.standard_normal(size)), 0.0
            v /= np.linalg.norm(v)
        right = np.column_stack([right, v])
        p = v - beta * left[:, -1] if beta else v
        image, square = product(p)
        for again in range(2):
            shares = left.T @ image  # U'Xp
            p, image, rest = p - left @ shares, image - images @ shares, square - float(shares @ shares)
            if again or rest > square / 2:  # little was taken off: what is left is orthogonal to rounding
                square = rest
                break
            image, square = product(p)
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha)
        if beta:
            entries.append((left.shape[1] - 1, step, beta))
        found += beta**2
        if alpha <= ZERO * largest:
            v = None
            continue
        left, images = np.column_stack([left, p / alpha]), np.column_stack([images, image / alpha])
        entries.append((left.shape[1] - 1, step, alpha))
        found += alpha**2
        residual = apart(images[:, -1] - alpha * v)
        beta = float(np.linalg.norm(residual))
        largest = max(largest, beta)
        v = residual / beta if beta > ZERO * largest else None
        if steps and step + 1 >= min(steps, size - 1) and v is not None:
            ends, values, _ = np.linalg.svd(_small(entries, left.shape[1], right.shape[1]))
            if (beta * np.abs(ends[-1, :want]) > SETTLED * values[0]).any():
                raise RuntimeError(f"components have not settled in {steps} steps")
            break
    _, values, turned = np.linalg.svd(_small(entries, left.shape[1], right.shape[1]), full_matrices=False)
    return values, right @ turned.T


def _small(entries: list[tuple[int, int, float]], rows: int, columns: int) -> np.ndarray:
    """The bidiagonal matrix U'XV."""
    out = np.zeros((rows, columns))
    for i, j, value in entries:
        out[i, j] = value
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, steps: int | None = None) -> Whitening:
    """The whitening of the distinct ``x`` of ``vectors``: exact sums, the components of the largest eigenvalues, the trace.

    Each distinct vector counts once, and copies meet before the shuffle. Components whose eigenvalue is zero (beside the
    largest, to ``ZERO``) are none, so that there may be fewer than asked for, or none at all.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    with scope(spark):
        rows = stash(vectors.select("x").distinct(), "vectors")
        first = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("size")).first()
        n, size = int(first["n"]), int(first["size"] or 0)
        sums = summed(rows, lambda x: x.sum(axis=0), size, "long") if n and size else np.zeros(size, np.int64)
        out = Whitening(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
        if n < 2 or not size:
            return out
        squares = summed(rows, lambda x: (out.centred(x) ** 2).sum(axis=0), size)
        total = float(squares.sum())

        def product(p: np.ndarray) -> tuple[np.ndarray, float]:
            def both(x: np.ndarray) -> np.ndarray:
                centred = out.centred(x)
                u = centred @ p
                return np.append(u @ centred, u @ u)

            got = summed(rows, both, size + 1)
            return got[:-1], float(got[-1])

        values, right = bidiagonalise(product, size, total, components, steps)
        keep = np.flatnonzero(values > ZERO**0.5 * values[0])[:components] if len(values) else np.zeros(0, int)
        chosen = right[:, keep]
        signs = np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(keep))]) if len(keep) else np.zeros(0)
        out = Whitening(n, sums, chosen * signs, values[keep] ** 2 / n, total / n)
        if len(keep):
            r = len(keep)

            def moments(x: np.ndarray) -> np.ndarray:
                w = out.project(x)
                return np.append((w.T @ w).ravel(), w.sum(axis=0))

            got = summed(rows, moments, r * r + r)
            mean = got[r * r :] / n
            out.identity_error = float(np.abs(got[: r * r].reshape(r, r) / n - np.outer(mean, mean) - np.eye(r)).max())
        return out


_WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(batches: Iterator[pa.RecordBatch], fitted: Whitening) -> Iterator[pa.RecordBatch]:
    r = len(fitted.values)
    for batch in batches:
        if not batch.num_rows or not r:
            continue
        x = _matrix(batch.column("x"))
        away = fitted.n * x - fitted.sums
        near = (away.astype(float) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-12)
        deviation = pa.array((away**2).sum(axis=1), pa.int64(), mask=np.repeat(~near, 1))
        each = pa.array(np.repeat(np.arange(batch.num_rows), r))
        rows = len(each)
        columns = [
            batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(rows, fitted.n)), deviation.take(each),
            pa.array(fitted.project(x).ravel()), pa.array(np.tile(fitted.values / fitted.trace, batch.num_rows)), pa.array(np.full(rows, fitted.identity_error)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(embeddings: DataFrame, components: int = COMPONENTS, steps: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row's whitened coordinates.

    Rows without a whole vector (see ``whole_vectors``) go. Repeated rows, and rows of a null id, have results like any
    other; repeated vectors count once in the fit. Without two different vectors there are no components, so no rows.
    ``deviation`` is null where it does not fit a long. Extra columns are ignored.
    """
    source = whole_vectors(embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")))
    fitted = fit(source, components, steps)
    return source.select("vec_id", "x").mapInArrow(lambda it: _whitened(it, fitted), _WHITE)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened coordinates of each row of ``embeddings`` with a whole vector; rows with nulls or no numbers go."""
    return whiten(table(spark, sf_dir, "embeddings"))
