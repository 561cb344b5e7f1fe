"""Quality classification by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Filters
of eight bytes (weights for each byte at each place) run over every chunk with
a stride of two, their rectified responses are max-pooled in the chunk, and the
chunks' means and maxima go into one logistic unit.  Training backpropagates
through the pooling by minibatches of all chunks of a bounded sample of labelled
texts (about ``per_label`` a label, fewer if they have over ``train_bytes``
bytes, none over a sixteenth of that by itself); scoring always reads whole
texts.  Classes are sampled evenly and the score is put back on their true
shares.

Defined cases: null and empty texts are one chunk of zero bytes and get a
score; without labels of both kinds all scores are the share of label 1, or 1
without any; repeated rows get equal scores; columns other than id, text and
(to learn) label are not read; a null id is a training row (``held_out`` is
false).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._learn import sample_labelled
from strophe.llm._text import add_columns, bytes_of, checkpoint, give_back, held_out

CHUNK, STEP, SPAN, FILTERS = 512, 448, 8, 24
#: Positions of a filter in a chunk.
PLACES = (CHUNK - SPAN) // 2 + 1


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks over n bytes; the last ends at the end."""
    if n <= CHUNK:
        return np.zeros(1, dtype=np.int64)
    return np.append(np.arange(0, n - CHUNK, STEP), (n - CHUNK + 1) // 2 * 2)


def chunks_of(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.zeros(starts[-1] + CHUNK, dtype=np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return padded[starts[:, None] + np.arange(CHUNK)]


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.t = rng.normal(0, 0.3, (SPAN, 256, FILTERS)).astype(np.float32)
        self.c = np.zeros(FILTERS, dtype=np.float32)
        self.u = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.v = np.zeros(1, dtype=np.float32)
        self.shift = 0.0
        self.constant: float | None = None
        self.pairs: list[np.ndarray] | None = None

    def pack(self) -> None:
        """Tables for two bytes at once, which scoring uses: 25 MB, made where
        they are used."""
        self.pairs = [(self.t[k][None, :, :] + self.t[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, SPAN, 2)]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """[chunks, places, filters] before rectification, by single bytes."""
        out = np.zeros((len(chunks), PLACES, FILTERS), dtype=np.float32)
        for k in range(SPAN):
            out += self.t[k][chunks[:, k : k + 2 * PLACES - 1 : 2]]
        return out + self.c

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """[chunks, filters]: pooled responses of a whole text, piecewise."""
        if self.pairs is None:
            self.pack()
        starts = chunk_starts(len(data))
        n = int(starts[-1]) + CHUNK
        out = np.empty((len(starts), FILTERS), dtype=np.float32)
        for k in range(0, len(starts), 128):
            s = starts[k : k + 128]
            part = data[s[0] : s[-1] + CHUNK]
            if len(part) < s[-1] + CHUNK - s[0]:
                part = np.concatenate([part, np.zeros(s[-1] + CHUNK - s[0] - len(part), np.uint8)])
            pair = np.ascontiguousarray(part).view("<u2")
            m = len(pair) - SPAN // 2 + 1
            r = self.pairs[0][pair[:m]]
            for j in range(1, SPAN // 2):
                r += self.pairs[j][pair[j : j + m]]
            at = (s - s[0]) // 2
            for i, a in enumerate(at):
                out[k + i] = r[a : a + PLACES].max(axis=0)
        assert n >= len(data)
        return np.maximum(out + self.c, 0)

    def score(self, data: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        p = self.pooled(data)
        z = float(np.concatenate([p.mean(axis=0), p.max(axis=0)]) @ self.u + self.v[0]) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 3) -> None:
        """texts: chunks of each text."""
        rng = np.random.default_rng(seed)
        params = [self.t, self.c, self.u, self.v]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                chunks = np.concatenate([texts[i] for i in own])
                many = np.array([len(texts[i]) for i in own])
                begin = np.concatenate([[0], np.cumsum(many)[:-1]])
                r = self.responses(chunks)
                place = r.argmax(axis=1)
                top = np.maximum(np.take_along_axis(r, place[:, None, :], axis=1)[:, 0], 0)
                mean = np.add.reduceat(top, begin) / many[:, None]
                high = np.maximum.reduceat(top, begin)
                x = np.concatenate([mean, high], axis=1)
                z = x @ self.u + self.v
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                gu, gv = x.T @ g + 1e-4 * self.u, g.sum(keepdims=True)
                gx = g[:, None] * self.u
                doc = np.repeat(np.arange(len(own)), many)
                gtop = gx[doc, :FILTERS] / many[doc][:, None]
                best = top == high[doc]
                gtop = gtop + best * gx[doc, FILTERS:] / np.maximum(1, np.add.reduceat(best.astype(np.float32), begin)[doc])
                gtop = np.where(top > 0, gtop, 0)
                gt = np.zeros_like(self.t)
                rows, cols = np.nonzero(gtop)
                at = 2 * place[rows, cols]
                for j in range(SPAN):
                    np.add.at(gt[j], (chunks[rows, at + j], cols), gtop[rows, cols])
                step += 1
                lr = rate * (1 - 0.8 * epoch / epochs)
                for p, m, v, gp in zip(params, first, second, [gt, gtop.sum(axis=0), gu, gv], strict=True):
                    m += 0.1 * (gp - m)
                    v += 0.01 * (gp * gp - v)
                    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", train=None, per_label: int = 1200, train_bytes: int = 16 << 20) -> Network:
    """Fit to ``docs`` (doc_id, text) labelled in ``labels`` (doc_id, label)
    where ``train``, a condition on doc_id, holds."""
    sample, counts = sample_labelled(docs, labels, label, per_label, train)
    net = Network()
    if len(counts) < 2:
        net.constant = float(next(iter(counts), 1))
        return net
    sample = checkpoint(sample.select(F.coalesce("text", F.lit("")).cast("binary").alias("data"), label).where(F.octet_length("data") <= train_bytes // 16))
    total = sample.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    unit = F.pmod(F.xxhash64(F.lit(13), "data"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = sample.where(unit < train_bytes / max(total, train_bytes)).toPandas().sort_values([label, "data"])
    y = got[label].to_numpy(np.float32)
    if not 0 < y.sum() < len(y):
        net.constant = counts.get(1, 0) / sum(counts.values())
        return net
    net.fit([chunks_of(np.frombuffer(x, np.uint8), chunk_starts(len(x))) for x in got["data"]], y)
    net.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    give_back()
    return net


def score(docs: DataFrame, net: Network, *, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold``)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        net = shared.value

        def apply(text):
            buf, offsets = bytes_of(text)
            s = np.array([net.score(buf[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

        return apply

    return add_columns(docs, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep=keep)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = held_out("doc_id", 5, 0)
    net = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=~held)
    return score(docs.withColumn("held_out", held), net, keep=["doc_id", "held_out"])
