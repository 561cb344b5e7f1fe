"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1; one binary classifier over hashed
byte n-grams (lengths 1 to 3, A-Z lower-cased, square roots of frequencies)
is trained for each bit.  Decoding sums, over the bits, the logistic loss of
the bit's margin against the codeword, weighted by how reliable the bit was
on the training rows, and takes the nearest codeword.  A text whose two
nearest codewords are closer than ``margin`` is flagged as ambiguous.

Up to 7 languages use the exhaustive code, which tolerates the most wrong
bits; more use the best of 64 random codes.  Training takes a hashed sample of
about ``per_language`` rows a language, as count vectors of fixed size.

Defined cases: a null text, and a text without a letter, is ``und`` with score
0; without training rows everything is; of equally near codewords the first
language by name; a null id is a training row (``held_out`` is false); repeated
rows get equal answers; columns other than id, text and (to learn) language are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._learn import sample_by_label
from strophe.llm._text import LOWER, add_columns, bytes_of, held_out

UNKNOWN = "und"
D1, D2, D3 = 256, 2048, 4096
WIDTH = D1 + D2 + D3
PIECE = 1 << 19


def counts(data: np.ndarray) -> np.ndarray:
    """Hashed counts of the byte n-grams of one text, piece by piece."""
    out = np.zeros(WIDTH, dtype=np.int64)
    for k in range(0, len(data), PIECE):
        x = LOWER[data[k : k + PIECE + 2]].astype(np.uint32)
        own = min(PIECE, len(x))
        out[:D1] += np.bincount(x[:own], minlength=D1)
        pair = (x[:-1] << 8) | x[1:]
        out[D1 : D1 + D2] += np.bincount(((pair * np.uint32(2654435761)) >> np.uint32(21))[:own], minlength=D2)
        triple = (pair[:-1] << 8) | x[2:]
        out[D1 + D2 :] += np.bincount(((triple * np.uint32(2246822519)) >> np.uint32(20))[:own], minlength=D3)
    return out


def features(c: np.ndarray) -> np.ndarray:
    x = np.sqrt(c.astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-6)


def codewords(n: int) -> np.ndarray:
    """[n, bits] of +1 and -1, rows and columns all different."""
    if n < 2:
        return np.ones((n, 0), dtype=np.float32)
    if n <= 7:
        bits = [[1 if (k >> i) & 1 else -1 for k in range((1 << (n - 1)) - 1)] for i in range(n - 1)]
        return np.array([[1] * ((1 << (n - 1)) - 1), *bits], dtype=np.float32)
    rng, best, far = np.random.default_rng(17), None, -1.0
    width = math.ceil(10 * math.log2(n))
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), (n, width))
        least = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if least > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, least
    return best


class Model:
    def __init__(self, x: np.ndarray, labels: list[str], steps: int = 120, rate: float = 0.5, decay: float = 1e-5):
        self.languages = sorted(set(labels))
        self.code = codewords(len(self.languages))
        y = self.code[np.searchsorted(self.languages, labels)] if labels else self.code[:0]
        self.w = np.zeros((WIDTH, self.code.shape[1]), dtype=np.float32)
        self.b = np.zeros(self.code.shape[1], dtype=np.float32)
        self.trust = np.ones(self.code.shape[1], dtype=np.float32)
        if not y.size:
            return
        m, v = np.zeros_like(self.w), np.zeros_like(self.w)
        for t in range(1, steps + 1):
            f = x @ self.w + self.b
            g = -y / (1 + np.exp(np.clip(y * f, -30, 30))) / len(x)
            gw = x.T @ g + decay * self.w
            m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
            self.w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.b -= 5 * rate * g.sum(axis=0)
        wrong = ((x @ self.w + self.b) * y <= 0).mean(axis=0)
        self.trust = (1 - np.minimum(0.499, wrong + 1 / len(x)) * 2).astype(np.float32)

    def distances(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.w + self.b
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None])
        return (loss * self.trust).sum(axis=2) / max(1e-6, float(self.trust.sum()))


def learn(rows: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "lang", per_language: int = 500, most_rows: int = 10_000) -> Model:
    """Fit to about ``per_language`` rows of each language; ``most_rows`` (256
    MB of counts, and as much again as features) bounds the driver's memory
    where there are over 20 languages."""
    rows = rows.where(F.col(text_col).rlike(r"\p{L}"))
    sample, _ = sample_by_label(rows, label, id_col, per_language, most_rows=most_rows)

    def make():
        def apply(text):
            buf, offsets = bytes_of(text)
            return [pa.array([np.minimum(counts(buf[a:b]), 2**31 - 1).astype(np.int32).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())]

        return apply

    got = add_columns(sample, [text_col], [T.StructField("counts", T.BinaryType())], make, keep=[label]).toPandas()
    got = got.sort_values([label, "counts"])
    x = features(np.stack([np.frombuffer(c, np.int32) for c in got["counts"]])) if len(got) else np.zeros((0, WIDTH), np.float32)
    return Model(x, got[label].tolist())


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", margin: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = "__has_letter"
    keep = [c for c in docs.columns if c != flag] if keep is None else keep

    def make():
        model = shared.value

        def apply(text, has_letter):
            buf, offsets = bytes_of(text)
            has = np.array(has_letter.fill_null(False).to_pylist(), dtype=bool)
            pred, score, doubt = [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text), dtype=bool)
            rows = np.flatnonzero(has) if model.languages else np.zeros(0, int)
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                d = model.distances(features(np.stack([counts(buf[offsets[i] : offsets[i + 1]]) for i in part])))
                p = np.exp(-8 * (d - d.min(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                best = d.argmin(axis=1)
                near = np.sort(d, axis=1)
                for i, b in zip(part, best, strict=True):
                    pred[i] = model.languages[b]
                score[part] = p[np.arange(len(part)), best]
                doubt[part] = (near[:, 1] - near[:, 0] < margin) if d.shape[1] > 1 else False
            return [pa.array(pred, pa.string()), pa.array(score), pa.array(doubt)]

        return apply

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return add_columns(docs.withColumn(flag, F.col(text_col).rlike(r"\p{L}")), [text_col, flag], fields, make, keep=keep)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = held_out("doc_id", 5, 0)
    model = learn(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])
