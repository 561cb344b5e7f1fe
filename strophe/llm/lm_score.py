"""Language-model scores of whole texts.

Two models learn from the training texts, and both give probabilities to the
words that those have and to one more token, any other word.  The base is a
smoothed unigram model over exact counts.  The other is a gated recurrent
network (``gru``) over the most frequent words; a word beyond them is one of
``kinds`` kinds of words by its last two bytes, and then, by exact smoothed
counts, the word of its kind.  The network's output biases begin as the exact
shares of words and kinds, so that training starts from the unigram model.  It
learns from all training texts: from a start on a sample, tasks train copies on
the texts they read, and the copies are averaged by their tokens, once for each
of ``rounds`` shares of the texts.  So ``score`` depends a little on how the
rows are dealt to tasks.

Counts are rows of a token's 64-bit hash, pre-aggregated in the tasks and summed
by a shuffle; only the at most ``most_words`` most frequent are broadcast.  The
other tokens of a text are looked up by a join on the hash.  Such a token is
rare in the training texts, and texts are held out by their ids, so no key of
the join is hot; the texts themselves are not shuffled.

Defined cases: a null or empty text is one end token; without training texts
the base score of a token is log10(0.1 / 0.1) = 0, and so is the score of a
word's place in its kind; rows with a null id are training rows; repeated rows
are each answered; other columns are not read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm._text import LOWER, SOLID, blocks, bytes_of, checkpoint, held_out, words
from strophe.llm.gru import Gru

END = np.uint64(0x0E4D0F7E875AFE77)  # stands for the end token
FLUSH = 2_000_000
SCAN = 8 << 20
LEARN = 1 << 20
#: Tokens of the texts that the network scores at once (4 bytes each).
SCORE = 4 << 20
PIECE = 1 << 14
#: Results of so many tasks are summed up at once.
FAN = 64


def tokens(buf: np.ndarray, offsets: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, the places where each text begins,
    and the tokens' kinds (of the end token: 0)."""
    starts, ends, h, at = words(buf, offsets, SOLID)
    n = np.diff(at)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(begin[-1], END, dtype=np.uint64)
    place = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
    out[place] = h
    kind = np.zeros(begin[-1], dtype=np.int32)
    last = LOWER[buf[ends - 1]].astype(np.uint32)
    before = np.where(ends - starts > 1, LOWER[buf[np.maximum(ends - 2, 0)]], 0).astype(np.uint32)
    kind[place] = (((last << 8 | before) * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(kinds)
    return out, begin, kind


def summed(h: np.ndarray, kind: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their kinds and their summed counts (n: ones)."""
    coded = pa.array(h).dictionary_encode()
    at, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    own = np.empty(len(keys), kind.dtype)
    own[at] = kind  # equal for equal hashes
    return keys, own, np.bincount(at, n, len(keys)).astype(np.int64)


def count_tokens(texts: DataFrame, text_col: str, kinds: int) -> DataFrame:
    """(hash, kind, n): the count of every token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush():
            k, own, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            k, own, c = summed(k, own, c)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(own), pa.array(c)], names=["hash", "kind", "n"])

        for batch in batches:
            buf, offsets = bytes_of(batch.column(0))
            for i, j in blocks(offsets):
                h, _, own = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kinds)
                parts.append(summed(h, own, None))
                held += len(parts[-1][0])
                if held > FLUSH:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return texts.select(text_col).mapInArrow(run, "hash long, kind int, n long").groupBy("hash").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))


def _end() -> int:
    return int(np.array([END]).view(np.int64)[0])


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, kinds and counts of at most ``most`` tokens, those whose counts
    are above a bound; the bound follows from how many tokens there are for
    each count, with counts rounded down to six leading bits."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2("n")) - 5))
    least = None
    for r in counts.select((F.floor(F.col("n") / unit) * unit).cast("long").alias("c")).groupBy("c").count().orderBy(F.desc("c")).collect():
        most -= r["count"]
        if most < 0:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    got = counts.where(F.col("n") >= least).select("hash", "kind", "n").toArrow()
    k, kind, c = (got.column(x).to_numpy() for x in ("hash", "kind", "n"))
    order = np.argsort(k.view(np.uint64))
    return k.view(np.uint64)[order], kind[order], c[order]


class Tables:
    """What scoring broadcasts: frequent counts, vocabulary, network, and the
    totals of kinds of words."""

    def __init__(self, keys: np.ndarray, kind: np.ndarray, counts: np.ndarray, kinds: dict[int, tuple[int, int]], n_texts: int, n_kinds: int, classes: int, per_class: int):
        n, v = n_texts + sum(x for x, _ in kinds.values()), bool(n_texts) + sum(x for _, x in kinds.values())
        if END not in keys:  # always listed, with its count
            at = int(np.searchsorted(keys, END))
            keys, kind, counts = np.insert(keys, at, END), np.insert(kind, at, 0), np.insert(counts, at, n_texts)
        self.keys, self.log, self.seen, self.n_kinds = keys, np.log10(counts + 0.1), counts > 0, n_kinds
        self.floor = float(np.log10(n + 0.1 * (v + 1)))
        self.net = Gru(classes, per_class)
        top = np.lexsort((keys, -counts))
        top = top[keys[top] != END][: self.net.begin - 1 - n_kinds]
        by = np.argsort(keys[top])
        self.vocab = keys[top][by]
        # kinds: tokens and distinct words beyond the vocabulary
        left = np.array([kinds.get(k, (0, 0)) for k in range(n_kinds)], float)
        np.subtract.at(left, kind[top], np.stack([counts[top], np.ones(len(top))], axis=1))
        self.kind_floor = np.log10(left[:, 0] + 0.1 * (left[:, 1] + 1))
        # numbers by rank, so that classes hold neighbours
        weight = np.concatenate([[n_texts], left[:, 0] + 0.1, counts[top]])
        rank = np.empty(len(weight), np.int64)
        rank[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
        self.end, self.kind_id, self.number = int(rank[0]), rank[1 : 1 + n_kinds], rank[1 + n_kinds :][by]
        self.net.begin_as(weight[np.argsort(rank)])

    @staticmethod
    def find(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return at, table[at] == h

    def ids(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of tokens, and which are words beyond the vocabulary."""
        at, hit = self.find(self.vocab, h)
        out = self.kind_id[kind]
        out[hit] = self.number[at[hit]]
        end = h == END
        out[end] = self.end
        return out, ~hit & ~end


def _sample(texts: DataFrame, text_col: str, shared, share: float, most: int) -> list[np.ndarray]:
    """Token numbers of a hashed share of the texts (at most ``most``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for batch in batches:
            t = t or shared.value
            buf, offsets = bytes_of(batch.column(0))
            out = []
            for i, j in blocks(offsets):
                h, begin, kind = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], t.n_kinds)
                ids, _ = t.ids(h, kind)
                out.extend(ids[a:b].astype(np.int32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    unit = F.pmod(F.xxhash64(F.lit(3), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = texts.select(text_col).where(unit < share).limit(most).mapInArrow(run, "ids binary").collect()
    return [np.frombuffer(x, np.int32).astype(np.int64) for x in sorted(r["ids"] for r in got)]


def _learn(texts: DataFrame, text_col: str, shared) -> np.ndarray:
    """Parameters of the network, one after the other, after training on the
    texts.  Tasks' results are summed up by pieces, ``FAN`` tasks at a time and
    their sums again, so no group grows with the tasks and the driver gets one
    row of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, net, adam, held, n_held, total = None, None, {}, [], 0, 0

        def fit():
            net.fit(held, streams=int(np.clip(n_held // 2048, 32, 512)), epochs=1, rate=0.004, adam=adam)
            held.clear()

        for batch in batches:
            t = t or shared.value
            net = net or copy.deepcopy(t.net)
            buf, offsets = bytes_of(batch.column(0))
            for i, j in blocks(offsets):
                h, begin, kind = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], t.n_kinds)
                ids, _ = t.ids(h, kind)
                held.extend(ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True))
                n_held += len(ids)
                total += len(ids)
                if n_held > LEARN:
                    fit()
                    n_held = 0
        if total:
            fit()
            flat = np.concatenate([p.ravel() for p in net.params()]).astype(np.float64) * total
            sums = [flat[k : k + PIECE] for k in range(0, len(flat), PIECE)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array([task] * len(sums), pa.int32()), pa.array([float(total)] * len(sums)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["piece", "task", "weight", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")  # sums of floats in one order
        total = None
        for x in table.column("sums"):
            x = np.frombuffer(x.as_py())
            total = x if total is None else total + x
        return pa.table({"piece": table.column("piece").slice(0, 1), "task": pa.array([table.column("task")[0].as_py() // FAN], pa.int32()), "weight": pa.array([sum(table.column("weight").to_pylist())]), "sums": pa.array([total.tobytes()], pa.binary())})

    shape = "piece int, task int, weight double, sums binary"
    sums = checkpoint(texts.select(text_col).mapInArrow(run, shape))
    tasks = sums.agg(F.coalesce(F.max("task") + 1, F.lit(0))).first()[0]
    while tasks > 1:
        sums = sums.groupBy("piece", F.floor(F.col("task") / FAN).alias("slot")).applyInArrow(merge, shape)
        tasks = -(-tasks // FAN)
    got = sorted(sums.collect(), key=lambda r: r["piece"])
    return np.concatenate([np.zeros(0), *(np.frombuffer(r["sums"]) / r["weight"] for r in got)])


def _score(docs: DataFrame, text_col: str, id_col: str, shared) -> DataFrame:
    """A row for each text, with its tokens that are not in the frequent list
    (hash, how often)."""
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    rare_type = pa.list_(pa.struct([("hash", pa.int64()), ("many", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, row = None, TaskContext.get().partitionId() << 40
        parts, texts, held = [], [], 0

        def flush():
            # many texts at once: few of them are long, and steps of few texts cost as much as others
            total, at = t.net.score(texts) / np.log(10), 0
            for cols, more, rest in parts:
                n = len(more)
                yield pa.RecordBatch.from_arrays([*cols, pa.array(total[at : at + n] + more), rest], names=["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
                at += n
            parts.clear()
            texts.clear()

        for batch in batches:
            t = t or shared.value
            buf, offsets = bytes_of(batch.column(2))
            for i, j in blocks(offsets, SCAN):
                h, begin, kind = tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], t.n_kinds)
                n, rows = np.diff(begin), j - i
                doc = np.repeat(np.arange(rows), n)
                # looked up once for each distinct token
                coded = pa.array(h).dictionary_encode()
                which, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
                own = np.empty(len(keys), kind.dtype)
                own[which] = kind
                at, hit = t.find(t.keys, keys)
                ids, beyond = t.ids(keys, own)
                ids, beyond = ids.astype(np.int32)[which], beyond[which]
                log = np.where(hit, t.log[at], 0.0)[which]
                base = np.bincount(doc, log, rows)
                known = np.bincount(doc, (hit & t.seen[at])[which], rows).astype(np.int64)
                hit = hit[which]
                texts.extend(ids[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True))
                more = np.bincount(doc[beyond], (log - t.kind_floor[kind])[beyond], rows)
                rare = np.flatnonzero(~hit)
                key, where = h[rare], doc[rare]
                order = np.lexsort((key, where))
                key, where = key[order], where[order]
                fresh = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (where[1:] != where[:-1])])) if len(key) else np.zeros(0, np.int64)
                many = np.diff(np.append(fresh, len(key))).astype(np.int32)
                cuts = np.searchsorted(where[fresh], np.arange(rows + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(key[fresh].view(np.int64)), pa.array(many)], names=["hash", "many"])
                lists = pa.ListArray.from_arrays(pa.array(cuts), pairs).cast(rare_type)
                parts.append(([pa.array(row + np.arange(rows)), batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(n), pa.array(known), pa.array(base - n * t.floor)], more, lists))
                row += rows
                held += len(ids)
                if held > SCORE:
                    yield from flush()
                    held = 0
        if parts:
            yield from flush()

    shape = f"row long, id {kind_of_id}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<hash:long,many:int>>"
    return docs.select(id_col, "held_out", text_col).mapInArrow(run, shape)


def fit(train: DataFrame, *, text_col: str = "text", most_words: int = 400_000, kinds: int = 63, classes: int = 32, per_class: int = 64, start_texts: int = 600, rounds: int = 2) -> tuple[Tables, DataFrame]:
    """The models of the training texts, and the counts of all their tokens."""
    sc = train.sparkSession.sparkContext
    counts = checkpoint(count_tokens(train, text_col, kinds))
    own = F.when(F.col("hash") != F.lit(_end()), F.col("kind"))
    totals = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy(own.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_texts = totals.pop(None, (0, 0))[0]
    tables = Tables(*_frequent(counts, most_words), totals, n_texts, kinds, classes, per_class)
    tables.train_tokens = n_texts + sum(x for x, _ in totals.values())
    if n_texts:
        tables.net.fit(_sample(train, text_col, sc.broadcast(tables), start_texts / n_texts, 2 * start_texts))
        for r in range(rounds):
            part = train.where(F.pmod(F.xxhash64(F.lit(5), F.col(text_col)), F.lit(rounds)) == r)
            flat = _learn(part, text_col, sc.broadcast(tables))
            for p in tables.net.params() if len(flat) else []:
                p[...] = flat[: p.size].reshape(p.shape)
                flat = flat[p.size :]
    return tables, counts


def score(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text", **model) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    all texts; the models learn (see ``fit``) from those where ``held_out`` is
    not true."""
    docs = docs.select(id_col, text_col, F.coalesce(held_out, F.lit(False)).alias("held_out"))
    tables, counts = fit(docs.where(~F.col("held_out")), text_col=text_col, **model)
    return apply(docs, tables, counts, id_col=id_col, text_col=text_col)


def apply(docs: DataFrame, tables: Tables, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score``'s columns of ``docs``, which have a column held_out."""
    scored = checkpoint(_score(docs, text_col, id_col, docs.sparkSession.sparkContext.broadcast(tables)))
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", "x.hash", "x.many").join(counts.select("hash", "n"), "hash", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))
    sums = rare.groupBy("row").agg(F.sum(F.col("many") * log).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("many")).otherwise(0)).alias("found"))
    more = F.coalesce("log", F.lit(0.0))
    return scored.drop("rare").join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(tables.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, held_out("doc_id", 10, 0))
