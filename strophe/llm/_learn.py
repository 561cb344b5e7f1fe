"""Bounded, repeatable training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_by_label(rows: DataFrame, label: str, key: str, per_label: int, most_labels: int = 10_000, most_rows: int | None = None) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of each label, fewer where all labels would be
    over ``most_rows``, at most twice that in all, chosen by a hash of ``key``;
    and the row counts by label.  Rows with a null label
    are left out.  Only counts by label reach the driver; over ``most_labels``
    labels are an error, none is left out.
    """
    rows = rows.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(label).limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"over {most_labels} values of {label}")
    if not counts:
        return rows.limit(0), counts
    if most_rows is not None:
        per_label = min(per_label, max(1, most_rows // len(counts)))
    kind = rows.schema[label].dataType.simpleString()
    shares = rows.sparkSession.createDataFrame([(value, min(1.0, per_label / n)) for value, n in counts.items()], f"__label {kind}, __share double")
    unit = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(shares), F.col(label) == F.col("__label")).where(unit < F.col("__share"))
    return drawn.drop("__label", "__share").limit(2 * per_label * len(counts)), counts


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, per_label: int, train=None) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) of a bounded sample of labelled documents, and the
    counts of labels 0 and 1 it is drawn from; ``train`` is a condition on
    doc_id.  Of repeated labels of an id the largest counts.  The sample is
    drawn from the labels, so at most ``4 * per_label`` ids are broadcast and
    no document is shuffled.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", label)
    if train is not None:
        known = known.where(train)
    known = known.groupBy("doc_id").agg(F.max(label).alias(label))
    ids, counts = sample_by_label(known, label, "doc_id", per_label, 2)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), counts
