"""Packing by optimal length buckets.

Texts are padded to the bound of their bucket.  The bounds minimise all padding
for a given number of buckets: dynamic programming over the exact global length
histogram, where each layer is solved by a lower hull of lines, as the cost of
a bucket is linear in its bound.  Inside a bucket, batches take as many texts
as the token budget has room for.  The length is that of the encoded text
(``token_counts``) and an end token; ``byte_length``, or any integer column, can
be given instead.

Only the histogram reaches the driver (a row for each length, so at most the
longest text's length).  Rows are shuffled once, without their text, to slices
of a bucket, which hold ``slice_batches`` batches on average, dealt by hashes of
id, text and the row's place, so that no id or text that many rows have makes a
slice large; only a slice's last batch may be short of texts, so no bucket is
ordered in one task.

Defined cases: null and empty texts have the end token only; a text longer than
the budget is a batch of its own, whole; an empty table gives no rows; rows of
one id, of none, and repeated rows are packed each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.llm._text import checkpoint
from strophe.llm.token_counts import with_lengths


def byte_length(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds (ascending, the last is the largest length) of at most
    ``buckets`` buckets with the least padding; lengths ascend."""
    m = len(lengths)
    if not m:
        return []
    c, s = [0], [0]
    for x, n in zip(lengths, counts, strict=True):
        c.append(c[-1] + n)
        s.append(s[-1] + n * x)
    cost = [lengths[j - 1] * c[j] - s[j] if j else 0 for j in range(m + 1)]
    cuts: list[list[int]] = []
    for _ in range(1, min(buckets, m)):
        # next[j] = min over i of cost[i] + lengths[j-1] * (c[j] - c[i]) - (s[j] - s[i])
        hull: list[tuple[int, int, int]] = []  # slope, offset, i; slopes fall
        head, best, cut = 0, [0] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            line = (-c[i], cost[i] + s[i], i)
            while len(hull) - head >= 2:
                (a1, b1, _), (a2, b2, _) = hull[-2], hull[-1]
                if (line[1] - b1) * (a1 - a2) <= (b2 - b1) * (a1 - line[0]):
                    hull.pop()
                else:
                    break
            hull.append(line)
            x = lengths[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            slope, offset, cut[j] = hull[head]
            best[j] = x * c[j] - s[j] + slope * x + offset
        cuts.append(cut)
        cost = best
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = cut[j]
    if j:
        out.append(lengths[j - 1])
    return out[::-1]


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = 16,
    budget: int = 65_536,
    slice_batches: int = 256,
) -> DataFrame:
    """id, n_tokens, bucket, pad_to, slice, batch, place: texts of one (bucket,
    slice, batch) are padded to pad_to together."""
    salt = F.xxhash64(id_col, text_col).alias("salt")
    if length is None:
        rows = with_lengths(docs.select(id_col, text_col, salt), text_col=text_col, keep=[id_col, "salt"]).withColumn("n_tokens", F.col("n_tokens") + 1)
    else:
        rows = docs.select(F.col(id_col), salt, length.cast("long").alias("n_tokens"))
    rows = checkpoint(rows).withColumn("salt", F.xxhash64("salt", F.monotonically_increasing_id()))
    hist = sorted((r[0], r[1]) for r in rows.groupBy("n_tokens").count().collect())
    bounds = best_bounds([x for x, _ in hist], [n for _, n in hist], buckets)
    bucket = pad = slices = room = F.lit(None)
    low = -1
    for b, top in reversed(list(enumerate(bounds))):
        low = bounds[b - 1] if b else -1
        n = sum(k for x, k in hist if low < x <= top)
        cap = max(1, budget // max(1, top))
        fits = F.col("n_tokens") <= top
        bucket, pad = F.when(fits, F.lit(b)).otherwise(bucket), F.when(fits, F.lit(top)).otherwise(pad)
        room = F.when(fits, F.lit(cap)).otherwise(room)
        slices = F.when(fits, F.lit(max(1, round(n / (cap * slice_batches))))).otherwise(slices)
    placed = rows.select(id_col, "salt", "n_tokens", bucket.cast("int").alias("bucket"), pad.cast("long").alias("pad_to"), room.cast("int").alias("room"), slices.cast("int").alias("slices"))
    placed = placed.withColumn("slice", F.pmod("salt", "slices").cast("int")).drop("slices")
    turn = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("n_tokens", id_col, "salt")) - 1
    return placed.withColumn("turn", turn).select(id_col, "n_tokens", "bucket", "pad_to", "slice", F.floor(F.col("turn") / F.col("room")).cast("long").alias("batch"), (F.col("turn") % F.col("room")).cast("int").alias("place"))


def op9_length_bucket_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
