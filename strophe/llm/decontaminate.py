"""Benchmark decontamination by a prefix-filtered containment join.

Every benchmark item gives windows of ``width`` consecutive words (an item of
fewer words is one window).  A document contains a window only if it contains
every shingle of it, so one shingle suffices to find it: shingles are ordered
by how often the corpus has them, and only each window's rarest one, its
prefix at containment 1, is joined with the documents' shingles.  A match at
some place fixes where the window would start; positional and length bounds
discard starts outside of the document, and survivors are verified word by
word.

Documents are not shuffled.  The joined side is an index over benchmark
segments; it is cut into blocks of at most ``block_words`` words, each block
is broadcast by itself, and a document row carries its merged hit spans from
block to block, so the index never outgrows that bound.

Defined cases: null and empty texts have no words and hit nothing; a null item
id marks words but is not listed; items that repeat an id count once; repeated
document rows are each answered; other columns of either table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._text import ALNUM, LOWER, add_columns, blocks, bytes_of, checkpoint, shingles, words

SHINGLE = 3
SEGMENT = 4096
_SHIFT = np.uint64(64 - 22)


def _segments(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item, words): normalised words of an item, cut into overlapping
    segments that together have just the item's windows."""
    src = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, out = [], []
            buf, offsets = bytes_of(batch.column(1))
            starts, ends, _, at = words(buf, offsets)
            low = LOWER[buf]
            for i, item in enumerate(batch.column(0).to_pylist()):
                own = [low[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]], strict=True)]
                for k in range(0, max(1, len(own) - width + 1), SEGMENT):
                    if own:
                        items.append(item)
                        out.append(own[k : k + SEGMENT + width - 1])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["item", "words"])

    return src.mapInArrow(run, "item string, words array<string>")


class Index:
    """Distinct windows of one block, reachable by shingle hash."""

    def __init__(self, segments: list[tuple[str | None, list[str]]], width: int):
        seen: dict[tuple[str, ...], set] = {}
        for item, own in segments:
            size = min(width, len(own))
            for k in range(len(own) - size + 1):
                items = seen.setdefault(tuple(own[k : k + size]), set())
                if item is not None:
                    items.add(item)
        self.texts = [" ".join(w).encode() for w in seen]
        self.items = [sorted(x) for x in seen.values()]
        self.size = np.array([len(w) for w in seen], dtype=np.int64)
        flat = b" ".join(self.texts)
        buf = np.frombuffer(flat, dtype=np.uint8)
        _, _, h, _ = words(buf, np.array([0, len(buf)]))
        first = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.words = np.zeros((len(self.texts), width), dtype=np.uint64)
        for w, n in enumerate(self.size):
            self.words[w, :n] = h[first[w] : first[w] + n]
        keys, wins, offs, kinds = [], [], [], []
        for n in np.unique(self.size):
            own, k = np.flatnonzero(self.size == n), min(SHINGLE, int(n))
            for o in range(int(n) - k + 1):
                s = np.zeros(len(own), dtype=np.uint64)
                for j, w in enumerate(own):
                    s[j] = shingles(self.words[w, o : o + k], k)[0]
                keys.append(s)
                wins.append(own)
                offs.append(np.full(len(own), o))
                kinds.append(np.full(len(own), k))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.key, self.win, self.off, self.kind = cat(keys, np.uint64), cat(wins, np.int64), cat(offs, np.int64), cat(kinds, np.int64)
        self.vocabulary = np.unique(self.key)
        self.kinds = sorted(set(self.kind.tolist()))

    def prefix(self, counts: dict[int, int]) -> None:
        """Keep each window's rarest shingle only (ties: the smaller hash)."""
        often = np.array([counts.get(i, 0) for i in range(len(self.vocabulary))], dtype=np.int64)[np.searchsorted(self.vocabulary, self.key)]
        order = np.lexsort((self.off, self.key, often, self.win))
        first = np.ones(len(order), dtype=bool)
        first[1:] = self.win[order][1:] != self.win[order][:-1]
        pick = order[first]
        pick = pick[np.argsort(self.key[pick], kind="stable")]
        self.key, self.win, self.off, self.kind = (x[pick] for x in (self.key, self.win, self.off, self.kind))
        self.vocabulary, self.begin = np.unique(self.key, return_index=True)
        self.begin = np.concatenate([self.begin, [len(self.key)]])
        self.kinds = sorted(set(self.kind.tolist()))

    def found(self, h: np.ndarray, bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, vocabulary numbers) of the shingles of ``h`` in the index."""
        for k in self.kinds:
            s = shingles(h, k)
            place = np.flatnonzero(bitmap[(s >> _SHIFT).astype(np.int64)])
            s = s[place]
            at = np.minimum(np.searchsorted(self.vocabulary, s), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == s
            yield place[hit], at[hit]

    def bitmap(self) -> np.ndarray:
        out = np.zeros(1 << 22, dtype=bool)
        out[(self.vocabulary >> _SHIFT).astype(np.int64)] = True
        return out


def _count(docs: DataFrame, text: str, index) -> DataFrame:
    """How often the documents have each shingle of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        bitmap, total = own.bitmap(), np.zeros(len(own.vocabulary), dtype=np.int64)
        for batch in batches:
            buf, offsets = bytes_of(batch.column(0))
            for i, j in blocks(offsets):
                _, _, h, _ = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for _, at in own.found(h, bitmap):
                    np.add.at(total, at, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    return docs.select(text).mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of half-open spans, as sorted disjoint rows."""
    if len(spans) < 2:
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[fresh, 0], reach[last]], axis=1)


def _match(index):
    def make():
        own = index.value
        bitmap = own.bitmap()
        width = own.words.shape[1]

        def apply(text: pa.Array, spans: pa.Array, items: pa.Array) -> list:
            buf, offsets = bytes_of(text)
            n_words = np.zeros(len(text), dtype=np.int64)
            spans, items = spans.to_pylist(), items.to_pylist()
            for i, j in blocks(offsets):
                low = LOWER[buf[offsets[i] : offsets[j]]]
                starts, ends, h, at = words(low, offsets[i : j + 1] - offsets[i])
                n_words[i:j] = np.diff(at)
                wins, begins = [], []
                for place, key in own.found(h, bitmap):
                    many = own.begin[key + 1] - own.begin[key]
                    entry = np.repeat(own.begin[key] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                    place = np.repeat(place, many)
                    wins.append(own.win[entry])
                    begins.append(place - own.off[entry])
                if not wins or not sum(map(len, wins)):
                    continue
                win, begin = np.concatenate(wins), np.concatenate(begins)
                size = own.size[win]
                ok = (begin >= 0) & (begin + size <= len(h))
                win, begin, size = win[ok], begin[ok], size[ok]
                doc = np.searchsorted(at, begin, side="right") - 1
                ok = begin + size <= at[doc + 1]
                win, begin, size, doc = win[ok], begin[ok], size[ok], doc[ok]
                ok = np.ones(len(win), dtype=bool)
                for k in range(width):
                    inside = size > k
                    ok &= ~inside | (h[np.where(inside, begin + k, 0)] == own.words[win, k])
                win, begin, size, doc = win[ok], begin[ok], size[ok], doc[ok]
                ok = np.array([b" ".join([low[s:e].tobytes() for s, e in zip(starts[b : b + n], ends[b : b + n], strict=True)]) == own.texts[w] for w, b, n in zip(win, begin, size, strict=True)], dtype=bool)
                win, begin, size, doc = win[ok], begin[ok], size[ok], doc[ok]
                order = np.argsort(doc, kind="stable")
                win, begin, size, doc = win[order], begin[order], size[order], doc[order]
                for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1):
                    if not len(part):
                        continue
                    d = doc[part[0]]
                    b = begin[part] - at[d]
                    new = np.stack([b, b + size[part]], axis=1)
                    old = np.array(spans[i + d] or [], dtype=np.int64).reshape(-1, 2)
                    spans[i + d] = _merge(np.concatenate([old, new])).ravel().tolist()
                    items[i + d] = sorted({*(items[i + d] or ()), *(x for w in np.unique(win[part]) for x in own.items[w])})
            return [pa.array(n_words), pa.array([x or [] for x in spans], pa.list_(pa.int64())), pa.array([x or [] for x in items], pa.list_(pa.string()))]

        return apply

    return make


FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_words: int = 1_000_000,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (disjoint half-open word spans,
    flattened) and items (sorted ids of the items with occurring windows)."""
    spark = docs.sparkSession
    segments = checkpoint(_segments(benchmark, item_id, item_text, width).distinct())
    total = segments.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_words))
    out, none = docs, True
    names = [f.name for f in FIELDS]
    for b in range(n_blocks):
        mine = segments if n_blocks == 1 else segments.where(F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)) == b)
        index = Index([(r["item"], r["words"]) for r in mine.collect()], width)
        if not index.texts and not (none and b == n_blocks - 1):
            continue
        if index.texts:
            shared = spark.sparkContext.broadcast(index)
            index.prefix({r["shingle"]: r["n"] for r in _count(docs, text_col, shared).collect()})
        else:
            index.vocabulary, index.begin, index.kinds = np.zeros(0, np.uint64), np.zeros(1, np.int64), []
        shared = spark.sparkContext.broadcast(index)
        if none:
            out = out.select(*[F.col(f"`{c}`") for c in out.columns if c not in names], F.lit(None).cast("array<long>").alias("hit_spans"), F.lit(None).cast("array<string>").alias("items"))
        out = add_columns(out, [text_col, "hit_spans", "items"], FIELDS, _match(shared))
        if n_blocks > 1:
            out = checkpoint(out)
        none = False
    return out


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    pairs = F.expr("aggregate(sequence(1, greatest(1, cast(size(hit_spans) / 2 as int))), 0L, (a, i) -> a + coalesce(try_element_at(hit_spans, 2 * i) - try_element_at(hit_spans, 2 * i - 1), 0L))")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        "n_words",
        pairs.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return digest(found.drop("text"))


LOWER_SQL = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words in DuckDB: the listed characters become spaces, the rest is split.
WORDS_SQL = "list_filter(string_split(regexp_replace(" + LOWER_SQL + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

SQL = f"""
with d as (select row_number() over () as r, doc_id, {WORDS_SQL.format('text')} as w from documents),
b as (select item_id, {WORDS_SQL.format('text')} as w from benchmark),
win as (
  select item_id, least(10, len(w)) as k, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) as t
  from b where len(w) > 0),
kinds as (select distinct k from win),
place as (
  select r, k, i, array_to_string(w[i : i + k - 1], ' ') as t
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, kinds where len(w) >= k)),
hit as (select p.r, p.i, p.k, n.item_id from place p join win n on n.k = p.k and n.t = p.t),
hw as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from hit) group by r),
hi as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(hw.n_hit, 0) as n_hit, coalesce(hi.n_items, 0) as n_items,
  sha256(coalesce(hi.ids, '')) as items_sha256, coalesce(hw.n_hit, 0) > 0 as contaminated
from d left join hw using (r) left join hi using (r)
"""
