"""Near duplicates of embeddings by sorted projection passes.

Each pass orders the vectors of a label by 64 concatenated bits, each the side
of a random plane that a vector lies on, and compares every vector with its
neighbours in that order: blocks of BLOCK sorted rows with themselves and with
the WINDOW rows before them, over the seams of partitions, too.  Passes have
planes of their own.  Links of all passes are united to components; then the
links inside of every component are counted exactly, so a link that no window
saw still counts if other links connect its ends.

* Exact copies count once (grouped by a 128-bit digest of label and vector,
  with partial sums), so no window is filled by copies.
* A pass moves unit vectors in half precision.  Their cosines are within
  ``slack`` of the true ones: pairs beyond it on either side are decided, and
  the few within it are compared in double precision afterwards.
* A window gives one edge a row at most (a spanning tree of its links).
* The number of passes follows from the size of the largest label: a pair at
  the threshold is missed with a chance of ``miss`` at most, if its vectors
  keep neighbours as unrelated vectors do.
* A component over PIECE vectors is cut by angle from its mean into rings, and
  rings into pieces.  Two angles that add up to less than the threshold's
  angle make a link, two that differ by more make none (triangle inequality);
  only pairs of pieces in between are compared.  Their number grows with the
  square of a component's size over PIECE: counting exact links of a wide
  cluster has no cheaper way here.

Defined cases: vectors that are null, empty or zero, or hold null or
non-finite entries, and rows without a label, link with nothing; vectors of
different lengths don't, either.  Repeated rows are vectors of their own.  A
null id is no component's smallest id unless there is none; ``kept`` compares
nulls as equal.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._text import checkpoint
from strophe.llm.graph import components

WINDOW, BLOCK, PIECE = 256, 512, 2048
BITS = 64
RINGS = 32


def _rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, size, key, v): v is the vector's bytes and key their
    digest with the label; both null where a vector can't link."""
    kind = np.float64 if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else np.float32
    names = ["vec_id", "label", "size", "key", "v"]
    shape = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label string, size int, key binary, v binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, key, size = [], [], []
            for label, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                x = np.zeros(0) if label is None or not x.is_valid or x.values.null_count else x.values.to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    fine = len(x) and 0 < np.square(x, dtype=np.float64).sum() < math.inf
                x = (x + 0).astype(kind).tobytes() if fine else None  # + 0: one zero only
                v.append(x)
                size.append(len(x) // kind().itemsize if fine else None)
                key.append(hashlib.blake2b(x, digest_size=16, person=hashlib.blake2b(label.encode(), digest_size=16).digest()).digest() if fine else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(v, pa.binary())], names=names)

    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(pack, shape)


def _unit(v: pa.Array, size: int, kind) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    x = np.frombuffer(b"".join(v.to_pylist()), kind).reshape(len(v), size).astype(np.float64)
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def _by_size(sizes: np.ndarray) -> Iterator[np.ndarray]:
    for s in np.unique(sizes):
        yield np.flatnonzero(sizes == s)


def n_passes(largest: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold is missed with a chance of
    ``miss``: in one pass it has to agree in the first bits of the order, as
    many as leave WINDOW of the ``largest`` label's vectors together."""
    bits = max(1.0, math.log2(max(2, largest) / WINDOW))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log1p(-agree)))


def _ordered(distinct: DataFrame, number: int, kind) -> DataFrame:
    """One pass's rows: label, size, order (64 bits), node, half-precision unit vector."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for b in batches:
            sizes = b.column(1).to_numpy(zero_copy_only=False)
            for at in _by_size(sizes):
                size = int(sizes[at[0]])
                if size not in planes:
                    planes[size] = np.random.default_rng([number, size]).normal(size=(size, BITS))
                u = _unit(b.column(3).take(pa.array(at)), size, kind)
                order = ((u @ planes[size] > 0) * weight).sum(1, dtype=np.uint64).view(np.int64)
                half = u.astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(order), b.column(2).take(pa.array(at)), pa.array([x.tobytes() for x in half], pa.binary())], names=["label", "size", "order", "node", "half"])

    return distinct.select("label", "size", "node", "v").mapInArrow(project, "label string, size int, order long, node long, half binary")


class _Windows:
    """Links of sorted rows of one vector length within blocks and windows."""

    def __init__(self, threshold: float, size: int):
        rounded = 2.0**-11 + 2.0**-24 * math.sqrt(size)
        slack = 2 * rounded + rounded**2 + 2.0**-20  # and the sums of single precision
        self.low, self.high = threshold - slack, threshold + slack
        self.edges: list[np.ndarray] = []
        self.unsure: list[np.ndarray] = []

    def compare(self, labels: np.ndarray, nodes: np.ndarray, x: np.ndarray, begin: int) -> None:
        """Rows from ``begin`` on with all rows before them and each other."""
        labels = np.unique(labels, return_inverse=True)[1]
        same = labels[begin:, None] == labels[None, :]
        cos = np.where(same, x[begin:] @ x.T, -2)
        n = len(x) - begin
        cos[np.arange(n), begin + np.arange(n)] = -2
        near = cos >= self.low
        if not near.any():
            return
        i, j = np.nonzero(near & (cos < self.high))
        i += begin
        once = (j < begin) | (i < j)
        self.unsure.append(np.stack([nodes[i[once]], nodes[j[once]]], 1))
        link = np.zeros((len(x), len(x)), bool)
        link[begin:] = cos >= self.high
        link[:, begin:] |= link[begin:].T
        root, before = np.arange(len(x)), None
        while before is None or (root != before).any():
            before = root
            root = np.minimum(root, np.where(link, root[None, :], len(x)).min(1))
            root = root[root]
        at = np.flatnonzero(root != np.arange(len(x)))
        self.edges.append(np.stack([nodes[at], nodes[root[at]]], 1))


FOUND = "a long, b long, sure boolean, seam int, after boolean, label string, size int, node long, half binary"
FOUND_NAMES = ["a", "b", "sure", "seam", "after", "label", "size", "node", "half"]


def _found(w: _Windows) -> Iterator[pa.RecordBatch]:
    for parts, sure in ((w.edges, True), (w.unsure, False)):
        if parts:
            e = np.unique(np.concatenate(parts), axis=0)
            n = len(e)
            parts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array([sure] * n, pa.bool_()), *(pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=FOUND_NAMES)


def _halves(half: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(half.to_pylist()), np.float16).reshape(len(half), size).astype(np.float32)


def _slide(threshold: float):
    """Over a sorted partition: links of its windows, and its first and last
    WINDOW rows, which go to its two seams."""

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail, w, size, head = None, None, None, 0

        def seam(rows: pa.RecordBatch, number: int, after: bool) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([number] * n, pa.int32()), pa.array([after] * n), rows.column(0), rows.column(1), rows.column(3), rows.column(4)], names=FOUND_NAMES)

        for b in batches:
            if head < WINDOW and len(b):
                yield seam(b.slice(0, WINDOW - head), part - 1, True)
                head += min(len(b), WINDOW - head)
            sizes = b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                for at in range(lo, hi, BLOCK):
                    block = pa.Table.from_batches([b.slice(at, min(BLOCK, hi - at))])
                    if size != sizes[at]:
                        if w:
                            yield from _found(w)
                        size, tail = int(sizes[at]), block.slice(0, 0)
                        w = _Windows(threshold, size)
                    rows = pa.concat_tables([tail, block]).combine_chunks()
                    w.compare(rows["label"].to_numpy(), rows["node"].to_numpy(), _halves(rows["half"].combine_chunks(), size), len(tail))
                    tail = rows.slice(max(0, len(rows) - WINDOW))
            if w:
                yield from _found(w)
        if tail is not None and len(tail):
            for r in tail.combine_chunks().to_batches():
                yield seam(r, part, False)

    return slide


def _sew(threshold: float):
    def sew(rows: pa.Table) -> pa.Table:
        out = []
        sizes = rows["size"].to_numpy()
        for at in _by_size(sizes):
            part = rows.take(pa.array(at)).sort_by("after").combine_chunks()
            size, w = int(sizes[at[0]]), _Windows(threshold, int(sizes[at[0]]))
            begin = int((~part["after"].to_numpy()).sum())
            if 0 < begin < len(part):
                w.compare(part["label"].to_numpy(), part["node"].to_numpy(), _halves(part["half"].combine_chunks(), size), begin)
                out += _found(w)
        shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])
        return pa.Table.from_batches([x.select(["a", "b", "sure"]) for x in out], shape) if out else shape.empty_table()

    return sew


def window_links(distinct: DataFrame, threshold: float, passes: int, kind) -> DataFrame:
    """(a, b, sure) of nodes that some pass has found; those not sure have yet
    to be compared in double precision."""
    out = None
    for number in range(passes):
        placed = _ordered(distinct, number, kind).repartitionByRange("size", "label", "order", "node").sortWithinPartitions("size", "label", "order", "node")
        found = checkpoint(placed.mapInArrow(_slide(threshold), FOUND))
        seams = found.where("seam >= 0").select("seam", "after", "label", "size", "node", "half").groupBy("seam").applyInArrow(_sew(threshold), "a long, b long, sure boolean")
        both = found.where("a is not null").select("a", "b", "sure").union(seams)
        out = both if out is None else out.union(both)
    return out.distinct()


def _true_links(unsure: DataFrame, distinct: DataFrame, threshold: float, kind) -> DataFrame:
    """Pairs of (a, b) whose cosine reaches the threshold."""
    left = distinct.select(F.col("node").alias("a"), F.col("v").alias("va"), "size")
    right = distinct.select(F.col("node").alias("b"), F.col("v").alias("vb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy(zero_copy_only=False)
            for at in _by_size(sizes):
                part = b.take(pa.array(at))
                cos = (_unit(part.column(3), int(sizes[at[0]]), kind) * _unit(part.column(4), int(sizes[at[0]]), kind)).sum(1)
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(cos >= threshold))

    return unsure.join(left, "a").join(right, "b").select("a", "b", "size", "va", "vb").mapInArrow(compare, "a long, b long")


def _count(threshold: float, kind):
    """Over rows sorted by job: each row's links to the other side of its job
    (to the other rows of its side, where a job has one), in copies."""

    def links(x, y, copies, alone):
        out = np.zeros(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            cos = x[at : at + BLOCK] @ y.T
            if alone:
                k = np.arange(len(cos))
                cos[k, at + k] = -2
            out[at : at + BLOCK] = (cos >= threshold) @ copies
        return out

    def solve(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        x = _unit(rows["v"].combine_chunks(), rows["size"][0].as_py(), kind)
        side, copies = rows["side"].to_numpy(), rows["copies"].to_numpy()
        one, two = side == 0, side == 1
        out = np.zeros(len(x), np.int64)
        if two.any():
            out[one], out[two] = links(x[one], x[two], copies[two], False), links(x[two], x[one], copies[one], False)
        else:
            out = links(x, x, copies, True)
        return pa.RecordBatch.from_arrays([rows["node"].combine_chunks(), pa.array(out)], names=["node", "links"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            job = np.stack([held[c].to_numpy() for c in ("root", "one", "two")], 1)
            cuts = [0, *(np.flatnonzero((job[1:] != job[:-1]).any(1)) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield solve(held.slice(lo, hi - lo))
            held = held.slice(cuts[-1])
        if held is not None and len(held):
            yield solve(held)

    return count


def _rings(large: DataFrame, kind, width: float) -> DataFrame:
    """The rows of large components with the ring they lie in, by the angle
    from their component's mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, sizes = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            for root in np.unique(roots):
                at = np.flatnonzero(roots == root)
                size = int(sizes[at[0]])
                s = _unit(b.column(2).take(pa.array(at)), size, kind).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, root)), pa.array(np.arange(size, dtype=np.int32)), pa.array(s)], names=["root", "k", "s"])

    mean = large.select("root", "size", "v").mapInArrow(sums, "root long, k int, s double").groupBy("root", "k").agg(F.sum("s").alias("s")).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("k", "s")))["s"].alias("mean"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, ring = b.column(1).to_numpy(zero_copy_only=False), np.zeros(len(b), np.int32)
            for at in _by_size(sizes):
                size = int(sizes[at[0]])
                mean = b.column(5).take(pa.array(at)).flatten().to_numpy().reshape(-1, size)
                norm = np.sqrt(np.square(mean).sum(1))
                cos = (_unit(b.column(4).take(pa.array(at)), size, kind) * mean).sum(1) / np.where(norm > 0, norm, 1)
                ring[at] = np.arccos(np.clip(cos, -1, 1)) // width
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ring)], names=["root", "size", "node", "copies", "v", "ring"])

    return large.select("root", "size", "node", "copies", "v").join(mean, "root").mapInArrow(place, "root long, size int, node long, copies long, v binary, ring int")


def exact_links(held: DataFrame, threshold: float, kind) -> DataFrame:
    """(node, links): links of every node to the others of its component, in
    copies; ``held`` has root, members, size, node, copies, v."""
    sides = ["root", "one", "two", "side", "size", "node", "copies", "v"]
    zero, no = F.lit(0).cast("long"), F.lit(0)
    small = held.where(F.col("members") <= PIECE).select("root", zero.alias("one"), zero.alias("two"), no.alias("side"), "size", "node", "copies", "v")
    theta = math.acos(threshold)
    width = theta / RINGS
    large = checkpoint(_rings(held.where(F.col("members") > PIECE), kind, width))
    rings = large.groupBy("root", "ring").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    # nodes are dealt to a ring's pieces by a hash: about PIECE / 2 each
    slots = rings.withColumn("pieces", F.ceil(F.col("n") * 2 / PIECE))
    pieces = checkpoint(large.join(slots.select("root", "ring", "pieces"), ["root", "ring"]).withColumn("piece", F.col("ring").cast("long") * (1 << 32) + F.pmod(F.xxhash64("node"), "pieces")).drop("pieces"))
    other = rings.select("root", F.col("ring").alias("other"), F.col("copies").alias("theirs"))
    all_in = (F.col("ring") + F.col("other") + 2) * width <= theta - 1e-9
    far = (F.abs(F.col("ring") - F.col("other")) - 1) * width > theta + 1e-9
    decided = rings.join(other, "root").where(all_in).groupBy("root", "ring").agg(F.sum("theirs").alias("sure"), F.max((F.col("ring") == F.col("other")).cast("int")).alias("own"))
    sure = pieces.join(decided, ["root", "ring"]).select("node", (F.col("sure") - F.col("own") * F.col("copies")).alias("links"))
    cells = pieces.select("root", "ring", "piece").distinct()
    pairs = cells.join(cells.select("root", F.col("ring").alias("other"), F.col("piece").alias("two")), "root").where((F.col("piece") <= F.col("two")) & ~all_in & ~far).select("root", F.col("piece").alias("one"), "two")
    first = pieces.withColumnRenamed("piece", "one").join(pairs, ["root", "one"]).withColumn("side", no)
    second = pieces.withColumnRenamed("piece", "two").join(pairs.where("one <> two"), ["root", "two"]).withColumn("side", F.lit(1))
    jobs = small.union(first.select(*sides)).union(second.select(*sides)).repartition("root", "one", "two").sortWithinPartitions("root", "one", "two")
    counted = jobs.mapInArrow(_count(threshold, kind), "node long, links long")
    return counted.union(sure).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, miss: float = 0.001) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id,
    embedding, label)."""
    kind = np.float64 if isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType) else np.float32
    rows = _rows(vectors)
    once = rows.where("key is not null").groupBy("key", "label", "size", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    distinct = checkpoint(once.withColumn("node", F.monotonically_increasing_id()))
    largest = distinct.groupBy("label", "size").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    found = checkpoint(window_links(distinct, threshold, n_passes(largest, threshold, miss), kind))
    edges = found.where("sure").select("a", "b").union(_true_links(found.where("not sure").select("a", "b"), distinct, threshold, kind))
    classes = checkpoint(components(edges))
    sizes = classes.groupBy("root").agg(F.count("*").alias("members"))
    held = checkpoint(distinct.select("node", "size", "copies", "v", "least").join(classes, "node").join(sizes, "root"))
    links = exact_links(held, threshold, kind)
    least = held.groupBy("root").agg(F.min("least").alias("smallest"))
    grouped = held.select("node", "root").join(links, "node", "left").join(least, "root")
    known = distinct.select("key", "node", "copies", "least").join(grouped, "node", "left").where("root is not null or copies > 1")
    known = known.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op12_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = r"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
n as (select a, count(*) as n from l group by a),
r as (select vec_id as x, vec_id as y from embeddings union select r.x, l.b from r join l on r.y = l.a),
c as (select x, min(y) as y from r group by x)
select vec_id, coalesce(n.n, 0) as n_links, c.y as component_id, vec_id = c.y as kept
from embeddings left join n on n.a = vec_id join c on c.x = vec_id
"""
