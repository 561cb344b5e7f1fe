"""The prefix trie of conversations, from their sorted order.

Conversations that share their first turns share a node of the trie for every
depth.  Sorted, the members of a node stand together, and a node that branches
is a node of the Cartesian tree over the LCP array (the numbers of turns that
neighbours share): it spans the places between its nearest smaller LCPs on
either side, and equal LCPs of a span are one node.

* A conversation is one binary row, its path: a cell of 20 bytes a turn (128
  bits of the SHA-256 of role and text, and the text's code points), so paths
  in byte order are conversations in trie order, and a path has all that the
  trie needs of its texts.
* Paths are range partitioned and sorted; each partition is a block.  One pass
  with a stack finds the nearest smaller LCPs inside of the block, merges equal
  ones, sends out every finished node at each of its depths, and adds the sums
  of a span to its parent.  What is left of a block are its minima: the LCPs
  that nothing smaller closes before the block's edge, with the sums between
  them, at most two for each depth of a conversation.
* The minima of FAN blocks at a time go through the same pass, until one block
  is left.  Only the numbers of partitions reach the driver.
* A node knows its parent by the digest of the parent's path; one join brings
  the parent's smallest member.

Defined cases: turns are ordered by turn (null first), then role and the
cell's bytes; null roles and texts are empty; repeated rows are turns of their
own; rows without a conv_id belong to no conversation and are left out; a base
that is absent adds no turns; conversations without turns are members of the
root; an empty table has no nodes.  Two turns count as equal if 128 bits of
SHA-256 agree.  A conversation's path (20 bytes a turn) has to fit into a row;
members of a node are never gathered, but the ids of equal conversations are
hashed in order, so one task reads them in runs of at most 256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm._text import checkpoint

CELL = 20
#: Blocks whose minima meet in one task.
FAN = 64
#: Ids of one run of a conversation's copies, as a power of two.
RUN = 8
NO_ONE = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.blake2b(b"", digest_size=16).digest()

NODES = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])
#: What is left of a block: its first and last path and its items, each an LCP,
#: a depth, the sums of a span and the digest of its last member's ids.
ITEM = pa.struct([("lcp", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("leaves", pa.int64()), ("all", pa.int64()), ("once", pa.int64()), ("kids", pa.int64()), ("ends", pa.string())])
LEFT = pa.schema([("block", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("left", pa.int64()), ("items", pa.list_(ITEM))])
SHAPE = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "block long, first binary, last binary, left long, items array<struct<lcp:long, depth:long, n:long, least:long, leaves:long, all:long, once:long, kids:long, ends:string>>"
)
BOTH = pa.schema([*NODES, *LEFT])
NOBODY = (1 << 63) - 1


def paths(conversations: DataFrame, group: int = 100, most_shared: int = 6) -> DataFrame:
    """(conv_id, path) of every rebuilt conversation: the first h turns of the
    conversation that begins its group, then its own after its first h; h is
    crc32(conv_id as text) modulo ``most_shared``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    cell = F.concat(digest, F.unhex(F.lpad(F.hex(F.char_length(text)), 8, "0")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), cell.alias("cell")).alias("t"))
    # binary cells go as text of one letter a byte, which arrays can be joined of
    held = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"))["cell"].alias("cells"))
    joined = lambda cells: F.unhex(F.array_join(F.transform(cells, F.hex), ""))
    own = held.select("conv_id", joined("cells").alias("path"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("shared", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("int") * CELL)
    base = own.where("conv_id = base").select("base", F.substring("path", 1, CELL * (most_shared - 1)).alias("lead"))
    rebuilt = F.concat(F.coalesce(F.expr("substring(lead, 1, shared)"), F.lit(b"")), F.expr("substring(path, shared + 1)"))
    return own.join(base, "base", "left").select("conv_id", rebuilt.alias("path"))


def _lcp(a: bytes, b: bytes) -> int:
    """Cells that two paths have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // CELL
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) // CELL


def _points(path: bytes) -> list[int]:
    """Code points of a path's first 0, 1, 2, ... texts."""
    sizes = np.frombuffer(path, np.uint8).reshape(-1, CELL)[:, 16:].copy().view(">u4").ravel()
    return [0, *np.cumsum(sizes, dtype=np.int64).tolist()]


class Span:
    """A node that is still open, with the sums of the paths it has so far:
    members, the smallest of them, childless nodes, code points of all
    members' texts, of the distinct nodes below it, and children."""

    __slots__ = ("all", "depth", "ends", "kids", "least", "leaves", "n", "once", "open")

    def __init__(self, depth: int, n=0, least=NOBODY, leaves=0, all=0, once=0, kids=0, ends=NO_ONE, open=False):  # noqa: A002
        self.depth, self.n, self.least, self.leaves, self.all, self.once, self.kids, self.ends, self.open = depth, n, least, leaves, all, once, kids, ends, open

    def add(self, other: Span) -> None:
        self.n += other.n
        self.least = min(self.least, other.least)
        self.leaves += other.leaves
        self.all += other.all
        self.once += other.once
        self.kids += other.kids
        if other.ends != NO_ONE:
            self.ends = other.ends


class Block:
    """One pass over a block of paths, or over the minima of several.

    The stack holds the open nodes of the path read last.  A node that has the
    block's first path may go on to the left: it is an item of what is left,
    unless the block begins the table (``whole``).
    """

    def __init__(self, whole: bool = False):
        self.whole, self.stack, self.items, self.first, self.path, self.points = whole, [], [], None, b"", [0]
        self.out: dict[str, list] = {f.name: [] for f in NODES}

    def shut(self, span: Span, upto: int) -> None:
        """Send out a finished node at every depth down to ``upto`` + 1, and
        leave its sums as those of a child of the node at ``upto``."""
        span.leaves = span.leaves if span.kids else 1
        c, o = self.points, self.out
        once = span.once
        for d in range(span.depth, upto, -1):
            once += c[d] - c[d - 1]
            deep, top = d == span.depth, d == upto + 1
            o["key"].append(self.key(d) if deep else None)
            o["parent_key"].append(self.key(upto) if top else None)
            o["conv_id"].append(span.least)
            o["depth"].append(d)
            o["parent_conv_id"].append(None if top else span.least)
            o["n_convs"].append(span.n)
            o["n_children"].append(span.kids if deep else 1)
            o["n_leaves"].append(span.leaves)
            o["saved_tokens"].append(span.all - span.n * c[d - 1] - once)
            o["ends_sha256"].append(span.ends if deep else NO_ONE)
        span.once, span.kids, span.ends = once, 1, NO_ONE

    def key(self, depth: int) -> bytes:
        return hashlib.blake2b(self.path[: depth * CELL], digest_size=16).digest()

    def fall(self, lcp: int) -> None:
        """Close what is deeper than ``lcp``; its node is then on top."""
        stack = self.stack
        while stack and stack[-1].depth > lcp:
            span = stack.pop()
            upto = max(lcp, stack[-1].depth) if stack else lcp
            if span.open:
                self.items.append(span)
                stack.append(Span(lcp, open=True))
                return
            self.shut(span, upto)
            if not stack or stack[-1].depth < upto:
                stack.append(Span(upto))
            stack[-1].add(span)

    def take(self, lcp: int, span: Span) -> None:
        """The next span, which shares ``lcp`` turns with what came before."""
        if self.first is None:
            span.open = not self.whole
            self.stack.append(span)
            return
        self.fall(lcp)
        if span.depth > lcp:
            self.stack.append(span)
        else:
            self.stack[-1].add(span)

    def read(self, path: bytes, n: int, least: int, ends: str) -> None:
        points = _points(path)
        self.take(-1 if self.first is None else _lcp(self.path, path), Span(len(path) // CELL, n=n, least=least, all=n * points[-1], ends=ends))
        self.first = path if self.first is None else self.first
        self.path, self.points = path, points

    def read_left(self, first: bytes, last: bytes, left: int, items: list[dict]) -> None:
        """The items of a block; the first ``left`` of them are prefixes of
        its first path, the others of its last."""
        begins = _points(first), first
        ends = _points(last), last
        boundary = -1 if self.first is None else _lcp(self.path, first)
        for i, x in enumerate(items):
            lcp = boundary if i == 0 else x["lcp"]
            self.take(lcp, Span(x["depth"], x["n"], x["least"], x["leaves"], x["all"], x["once"], x["kids"], x["ends"]))
            self.first = first if self.first is None else self.first
            self.points, self.path = begins if i < left else ends
        self.points, self.path = ends

    def nodes(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.out["depth"]) >= least:
            yield pa.RecordBatch.from_arrays([*(pa.array(self.out[f.name], f.type) for f in NODES), *(pa.nulls(len(self.out["depth"]), f.type) for f in LEFT)], schema=BOTH)
            for x in self.out.values():
                x.clear()

    def rest(self, block: int) -> Iterator[pa.RecordBatch]:
        if self.first is None:
            return
        left = len(self.items) + 1  # and the lowest of the stack
        spans = [*self.items, *self.stack]
        # the lower nodes of the stack begin where the one above them has its own depth
        lcps = [-1, *(s.depth for s in spans[1:left]), *(s.depth for s in spans[left - 1 : -1])]
        items = [{"lcp": lcp} | {k.name: getattr(s, k.name) for k in ITEM if k.name != "lcp"} for lcp, s in zip(lcps, spans, strict=True)]
        row = {"block": block, "first": self.first, "last": self.path, "left": left, "items": items}
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in NODES), *(pa.array([row[f.name]], f.type) for f in LEFT)], schema=BOTH)

    def finish(self) -> None:
        """The end of the table: close all, and the root last."""
        self.fall(0)
        root, o = self.stack.pop(), self.out
        for k, v in (("key", ROOT), ("parent_key", None), ("conv_id", root.least), ("depth", 0), ("parent_conv_id", None), ("n_convs", root.n), ("n_children", root.kids), ("n_leaves", root.leaves if root.kids else 1), ("saved_tokens", root.all - root.once), ("ends_sha256", root.ends)):
            o[k].append(v)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of sorted (path, run, ids): digests of the ids of equal
    paths, and the first pass over the block."""
    block, path, n, least, sha = Block(), None, 0, NOBODY, None
    for b in batches:
        members, at = b.column(1).flatten().to_numpy(), np.r_[0, np.cumsum(b.column(1).value_lengths().to_numpy())]
        for i, p in enumerate(b.column(0)):
            p, ids = p.as_py(), members[at[i] : at[i + 1]].tolist()
            if p != path:
                if path is not None:
                    block.read(path, n, least, sha.hexdigest())
                    yield from block.nodes(5000)
                path, n, least, sha = p, 0, NOBODY, hashlib.sha256()
            sha.update(("," * bool(n) + ",".join(map(str, ids))).encode())
            n, least = n + len(ids), min(least, ids[0])
    if path is not None:
        block.read(path, n, least, sha.hexdigest())
    yield from block.nodes()
    yield from block.rest(TaskContext.get().partitionId())


def _merge(whole: bool):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        block = Block(whole)
        rows = rows.sort_by("block")
        for r in rows.to_pylist():
            block.read_left(r["first"], r["last"], r["left"], r["items"])
        if whole:
            block.finish()
        return pa.Table.from_batches([*block.nodes(), *([] if whole else block.rest(key[0].as_py()))], schema=BOTH)

    return merge


def trie(rebuilt: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, path)."""
    runs = checkpoint(rebuilt.groupBy("path", F.shiftright("conv_id", RUN).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")))
    placed = runs.repartitionByRange("path").sortWithinPartitions("path", "run").select("path", "ids")
    done = checkpoint(placed.mapInArrow(_scan, SHAPE))
    found, blocks = [done.where("depth is not null")], done.where("block is not null").select(*[f.name for f in LEFT])
    n = blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]
    while n > FAN:
        done = checkpoint(blocks.groupBy(F.floor(F.col("block") / FAN).alias("k")).applyInArrow(_merge(False), SHAPE))
        found, blocks = [*found, done.where("depth is not null")], done.where("block is not null").select(*[f.name for f in LEFT])
        n = -(-n // FAN)
    found.append(checkpoint(blocks.groupBy(F.lit(0).alias("k")).applyInArrow(_merge(True), SHAPE)))
    nodes = found[0]
    for x in found[1:]:
        nodes = nodes.union(x)
    # the root's children may be most of all nodes: its smallest member is a value, not a join
    least = found[-1].where("depth = 0").select("conv_id").first()
    parents = nodes.where("key is not null and depth > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    root = F.lit(least[0] if least else None).cast("long")
    above = nodes.where(F.col("parent_key") != F.lit(ROOT)).join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("found"))
    rest = nodes.where(F.col("parent_key").isNull() | (F.col("parent_key") == F.lit(ROOT))).withColumn("parent_conv_id", F.when(F.col("parent_key").isNotNull(), root).otherwise(F.col("parent_conv_id")))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return above.select(*shown).union(rest.select(*shown))


def op11_conversation_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: crc32 bit by bit: a byte is an entry below 256, a shift an entry of 256.
SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role)::varchar || ':' || role || text)) as k from t),
c as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(conv_id::varchar) + 1), lambda i: [ascii(substr(conv_id::varchar, i, 1))::bigint, 256, 256, 256, 256, 256, 256, 256, 256]))),
      lambda a, x: case when x < 256 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295::bigint) % 6 as h
  from (select distinct conv_id from t)),
r as (
  select c.conv_id, 0 as part, k, role, text from c join n on n.conv_id = c.base where k <= h
  union all
  select c.conv_id, 1, k, role, text from c join n on n.conv_id = c.conv_id where k > h),
s as (select c.conv_id, coalesce(list({'role': role, 'text': text} order by part, k) filter (where k is not null), []) as path from c left join r on r.conv_id = c.conv_id group by c.conv_id),
m as (select conv_id, len(path) as size, unnest(range(0, len(path) + 1)) as depth, path from s),
p as (select conv_id, size, depth, path[1 : depth] as node, case when depth > 0 then path[1 : depth - 1] end as above, coalesce(length(path[depth].text), 0) as points from m),
g as (
  select node, any_value(above) as above, any_value(depth) as depth, any_value(points) as points, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256
  from p group by node),
kids as (select above, count(*) as n from g where above is not null group by above),
f as (select g.*, coalesce(kids.n, 0) as n_children from g left join kids on kids.above = g.node),
u as (select node[1 : d] as top, (n_children = 0)::int as leaf, (n_convs - 1) * points as saved from (select *, unnest(range(0, depth + 1)) as d from f)),
w as (select top, sum(leaf)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from u group by top)
select f.conv_id, f.depth, a.conv_id as parent_conv_id, f.n_convs, f.n_children, w.n_leaves, w.saved_tokens, f.ends_sha256
from f join w on w.top = f.node left join g a on a.node = f.above
"""
