"""Token counts as an exact length histogram.

Every text is encoded by a public byte-level BPE; tasks count texts by encoded
length, and the counts are summed into one row a length.  Suffix sums over the
histogram answer, for every context limit, how many texts fit, how many are
longer, all tokens, and the tokens left if texts are truncated at the limit;
``quantile`` and ``truncated_total`` read answers from it.  Sums run inside
blocks of lengths and over the few blocks, never over all rows in one task.

Defined cases: null and empty texts have no tokens (length 0); an empty table
has an empty histogram; special-token strings are ordinary text; repeated rows
count as often as they stand; columns other than the text are not read.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._text import add_columns, checkpoint

#: Where every machine keeps the vocabulary (a file of its own, or one that
#: ``SparkContext.addFile`` brought there; its name alone is then enough).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of the vocabulary's texts into pieces before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1024

_loaded: dict = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN):
    """The encoding, loaded once in a process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def with_lengths(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_tokens, the encoded length."""

    def make():
        encode = encoder(path, pattern).encode_ordinary
        return lambda text: [pa.array([len(encode(x)) if x else 0 for x in text.to_pylist()], pa.int64())]

    return add_columns(docs, [text_col], [T.StructField("n_tokens", T.LongType())], make, keep=keep)


def histogram(docs: DataFrame, *, text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs), a row for each encoded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        encode = None
        for batch in batches:
            encode = encode or encoder(path, pattern).encode_ordinary
            for x in batch.column(0):
                text = x.as_py()
                seen[len(encode(text)) if text else 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select(text_col).mapInArrow(run, "n_tokens long, n_docs long").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for its lengths as limits: docs_fitting, docs_longer,
    tokens_fitting, tokens_total, truncated_total and quantile."""
    hist = checkpoint(hist)
    block = F.floor(F.col("n_tokens") / BLOCK)
    h = hist.withColumn("block", block).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    everything = sums.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("all_tokens"))
    blocks = sums.select("block", F.coalesce(F.sum("d").over(later), zero).alias("later_docs"), F.coalesce(F.sum("t").over(later), zero).alias("later_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(own), zero) + F.col("later_docs")
    longer_tokens = F.coalesce(F.sum("tokens").over(own), zero) + F.col("later_tokens")
    # a row for each block and one row of totals
    h = h.join(F.broadcast(blocks), "block").withColumn("docs_longer", longer).withColumn("longer_tokens", longer_tokens).crossJoin(F.broadcast(everything))
    fitting = F.col("all_tokens") - F.col("longer_tokens")
    return h.select(
        "n_tokens",
        "n_docs",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_fitting"),
        "docs_longer",
        fitting.alias("tokens_fitting"),
        F.col("all_tokens").alias("tokens_total"),
        (fitting + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that a share q of the texts does not exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every text is cut to ``limit`` tokens, for any limit."""
    at = F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "tokens_fitting", "docs_longer"))
    top = sums.agg(F.max(at).alias("x"), F.sum("n_docs").alias("n"))
    return top.select((F.coalesce(F.col("x.tokens_fitting"), F.lit(0)) + F.lit(limit) * F.coalesce(F.col("x.docs_longer"), F.col("n"), F.lit(0))).cast("long").alias("tokens"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return with_sums(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")))
