"""Whitening of embeddings: one row of covariance sums, components by LAPACK.

An entry c counts as the integer x = floor(64 c) + 1,000,000.  The covariance
is that of the distinct vectors of integers.  One Spark aggregation of
generated expressions sums the centred products of every pair of dimensions
(the upper triangle), so nothing but about d (d + 1) / 2 numbers reaches the
driver, whatever the table's size.

Defined cases: vectors that are null, empty, or hold null, infinite or NaN
entries have no rows; nor have vectors of another length than the most common
one (the shortest of equally common ones).  Entries beyond 2**46 in size count
as that.  Null and repeated ids keep their rows.  Components whose eigenvalue
is below 1e-10 of the largest can't be scaled to one and are left out, so a
table of equal vectors, or an empty one, gives no rows.  A deviation that no
long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm._text import stored

SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 52)
#: Dimensions of a tile of the upper triangle.
TILE = 8


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n vectors with sums S, unit components as columns
    with falling eigenvalues, and the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.eigenvalues)


def _integers(vector: str, d: int | None = None) -> Column:
    """A valid vector's integers; null if the vector isn't valid."""
    entry = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(F.greatest(F.least(entry(c) * float(SCALE), F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(SHIFT).cast("long"))
    size = F.size(vector) > 0 if d is None else F.size(vector) == d
    return F.when(F.col(vector).isNotNull() & size & fine, x)


def products(rows: DataFrame, entries: list[Column]) -> np.ndarray:
    """Sums of the products of every two entries, as a full matrix.

    The upper triangle is dealt into tiles of TILE x TILE pairs.  One
    aggregation by tile has a generated sum for every pair of a tile: a row
    with d (d + 1) / 2 sums outgrows what Spark compiles, one of TILE**2 does
    not, whatever d is.
    """
    d = len(entries)
    n = -(-d // TILE)
    tiles = F.array(*[F.struct(F.lit(i * TILE).alias("i"), F.lit(j * TILE).alias("j")) for i in range(n) for j in range(i, n)])
    padded = F.array(*entries, *[F.lit(0.0)] * (n * TILE - d)).alias("c")
    each = rows.select(padded).select("c", F.explode(tiles).alias("t")).select("c", "t.i", "t.j")
    pair = lambda a, b: F.sum(F.get("c", F.col("i") + a) * F.get("c", F.col("j") + b))
    sums = each.groupBy("i", "j").agg(*[pair(a, b).alias(f"s{a}_{b}") for a in range(TILE) for b in range(TILE)])
    out = np.zeros((n * TILE, n * TILE))
    for i, j, *s in sums.collect():
        block = np.array(s).reshape(TILE, TILE)
        out[i : i + TILE, j : j + TILE] = block
        out[j : j + TILE, i : i + TILE] = block.T
    return out[:d, :d]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n of rows of integers, and the exact sums of (n x - S)**2 as
    longs, with -1 where no long holds one."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    near = (x - whole) - part
    scaled = np.int64(n) * (x - whole) - np.array([s % n for s in sums], np.int64)
    fits = n * np.sqrt(np.square(near).sum(1)) < 3.03e9
    squares = np.square(np.where(fits[:, None], scaled, 0)).sum(1)
    return near, np.where(fits, squares, -1)


def fit(vectors: DataFrame, vector: str = "embedding", most: int = 16) -> Whitening | None:
    """The whitening of a table's vectors; None if nothing varies."""
    x = vectors.select(_integers(vector).alias("x")).where("x is not null")
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None
    d, names = sizes["d"], [f"x{i}" for i in range(sizes["d"])]
    # columns of small integers take a byte or two each in Parquet
    listed = stored(x.where(F.size("x") == d).distinct().select(*[F.col("x")[i].alias(c) for i, c in enumerate(names)]))
    n, *sums = listed.agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(20,0)")) for c in names]).first()
    sums = tuple(int(s) for s in sums)
    near = [(F.col(c) - F.lit(s // n).cast("long")).cast("double") - F.lit((s % n) / n) for c, s in zip(names, sums, strict=True)]
    covariance = products(listed, near) / n
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    kept = int((values[:most] > 1e-10 * values[0]).sum()) if values[0] > 0 else 0
    if not kept:
        return None
    model = Whitening(int(n), sums, columns[:, :kept].copy(), values[:kept].copy(), float(np.trace(covariance)))
    return Whitening(model.n, model.sums, model.components, model.eigenvalues, model.trace, _identity_error(listed, model))


def _identity_error(listed: DataFrame, model: Whitening) -> float:
    """The largest entry of the fitted vectors' whitened covariance minus the
    identity, measured on the whitened vectors themselves."""
    names = [f"z{k}" for k in range(len(model.eigenvalues))]
    n, sums, scaled = model.n, model.sums, model.scaled

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns], 1)
            z = _centred(x, n, sums)[0] @ scaled
            yield pa.RecordBatch.from_arrays([pa.array(z[:, k]) for k in range(z.shape[1])], names=names)

    z = listed.mapInArrow(whiten, ", ".join(f"{c} double" for c in names))
    means = z.agg(*[F.avg(c) for c in names]).first()
    covariance = products(z, [F.col(c) - F.lit(m) for c, m in zip(names, means, strict=True)]) / n
    return float(np.abs(covariance - np.eye(len(names))).max())


def transform(vectors: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each valid vector and component: vec_id, component, n,
    deviation, whitened, explained, identity_error."""
    kind = vectors.schema[vec_id].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], shape)
    x = vectors.select(F.col(vec_id).alias("vec_id"), _integers(vector, len(model.sums)).alias("x")).where("x is not null")
    n, sums, scaled, error = model.n, model.sums, model.scaled, model.identity_error
    k, explained = len(model.eigenvalues), model.eigenvalues / model.trace

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            near, deviation = _centred(flat.reshape(b.num_rows, -1), n, sums)
            each = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                    pa.array(np.full(len(each), n, np.int64)),
                    pa.array(deviation[each], mask=deviation[each] < 0),
                    pa.array((near @ scaled).ravel()),
                    pa.array(np.tile(explained, b.num_rows)),
                    pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(whiten, shape)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return transform(vectors, fit(vectors))
