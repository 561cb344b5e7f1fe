"""License scan by ordered signature rules, in DataFrame expressions only.

A text is lower-cased (A-Z) and normalised to its words joined by single
spaces.  Two kinds of findings are made on it:

* base phrases: fixed word sequences, counted wherever they stand;
* signature rules (``license_rules``): a rule's expression is tried only on
  texts that contain the rule's keyword, and a cheap gate over a few roots
  spares most texts the keywords, too.  A detection goes if it lies inside of
  another of the same or a higher priority (of equal intervals the one of
  higher priority stays, then the earlier rule's); detections that only
  overlap, and a higher one inside of a lower one, stay.  A rule labelled
  ``NAMED`` takes its label from the identifier it matched.

All of it is row by row, without a shuffle; the rules are literals of fixed
size.  Folds over the n detections of a text run in blocks of about sqrt(n), so
that no array of n grows one by one.

Defined cases: null and empty texts have no words and no findings; ties in
start, end and priority stay by the order of rules; repeated rows get equal
answers; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.arrays import scan_blocks
from strophe.llm.license_rules import NAMED, TAG, identifiers
from strophe.llm.license_rules import rules as all_rules

#: Base phrases and labels, as the contract states them.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Most keywords contain one of these; another keyword is a root by itself.
ROOTS = (
    "licen", "spdx", "opensource org", "expat", "permission", "copyright", "as is", "x11", "x consortium", "mit no", "bsd", "neither the name",
    "advertising materials", "redistributi", "apache", "public", "gnu org", "gpl", "free software", "you should have received", "this library is",
    "invariant", "mozilla", "source code form", "eclipse", "common development", "zlib", "origin of this", "libpng", "boost", "business source",
    "ncsa", "python software", "unencumbered", "wtfpl", "beer ware", "creativecommons", "creative commons", "cc0", "cc by", "opendatacommons",
    "open data commons", "mulan psl", "microsoft", "educational community", "universal permissive", "w3c software", "openrail", "open rail", "commons clause",
    "all rights reserved", "confidential", "may not be reproduced", "unauthorized",
)


def normalised(text: Column) -> Column:
    """' w1 w2 ... ' or ' ' without words."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(" ")), SEPARATORS, " ")))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _any(norm: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | norm.contains(p)
    return out


_KIND = "struct<start:int,end:int,priority:int,rule:int,label:string>"


def _detections(norm: Column, rules: Sequence[tuple[str, int, str, str]]) -> Column:
    """All matches of the rules whose keyword occurs, as an array of
    (start, -end, -priority, rule number, label) in the order of resolution."""
    by_keyword: dict[str, list[Column]] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(r[2], []).append(F.struct(F.lit(rf"(?<= )(?:{r[3]})(?= )").alias("pattern"), F.lit(-r[1]).alias("priority"), F.lit(i).alias("rule"), F.lit(r[0]).alias("label")))
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*own).alias("rules")) for k, own in by_keyword.items()])
    # nested references are evaluated for every element, so each step uses its element only
    tried = F.flatten(F.transform(F.filter(table, lambda k: norm.contains(k["keyword"])), lambda k: k["rules"]))
    names = F.create_map(*[F.lit(x) for pair in identifiers().items() for x in pair])

    def matches(r: Column) -> Column:
        found = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
        pairs = F.filter(F.arrays_zip(F.split(norm, r["pattern"], -1).alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())  # the last gap has no hit

        def step(at: Column, p: Column) -> tuple[Column, Column]:
            start, end = at + F.length(p["gap"]), at + F.length(p["gap"]) + F.length(p["hit"])
            return end, F.array(F.struct(start.alias("start"), (-end).alias("end"), p["hit"].alias("hit")))

        walked = scan_blocks(pairs, F.lit(0), F.array().cast("array<struct<start:int,end:int,hit:string>>"), step)
        label = lambda x: F.when(r["label"] == NAMED, F.element_at(names, F.substring(x["hit"], len(TAG) + 1, 1 << 30))).otherwise(r["label"])
        return F.transform(walked, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["priority"].alias("priority"), r["rule"].alias("rule"), label(x).alias("label")))

    return F.array_sort(F.flatten(F.transform(tried, matches)))


def _resolved(found: Column, priorities: Sequence[int]) -> Column:
    """Detections that stay.  In their order, what may contain one stands
    before it; so the farthest end of each priority so far decides, and it
    does not matter whether its detection stayed: what contains that one
    contains this one, too."""
    tops = F.array(*[F.struct(F.lit(-p).alias("priority"), F.lit(0).alias("end")) for p in sorted(set(priorities))]) if priorities else F.array().cast("array<struct<priority:int,end:int>>")

    def step(tops: Column, d: Column) -> tuple[Column, Column]:
        inside = F.exists(tops, lambda t: (t["priority"] <= d["priority"]) & (t["end"] <= d["end"]))  # both negative
        after = F.transform(tops, lambda t: F.struct(t["priority"].alias("priority"), F.when(t["priority"] == d["priority"], F.least(t["end"], d["end"])).otherwise(t["end"]).alias("end")))
        return after, F.when(inside, F.array().cast(f"array<{_KIND}>")).otherwise(F.array(d))

    return scan_blocks(found, tops, F.array().cast(f"array<{_KIND}>"), step)


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[tuple[str, int, str, str]] | None = None,
    roots: Sequence[str] = ROOTS,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels (array),
    detections (array of start, end in the normalised text, priority, label)."""
    rules = all_rules() if rules is None else rules
    for phrase, _ in phrases:
        w = phrase.split()
        if any(w[:k] == w[-k:] for k in range(1, len(w))):
            raise ValueError(f"occurrences of a base phrase may not overlap: {phrase}")
    roots = [*roots, *sorted({r[2] for r in rules if not any(x in r[2] for x in roots)})]
    d = docs.select(F.col(id_col), normalised(F.col(text_col)).alias("norm"))
    norm = F.col("norm")
    d = d.select(id_col, "norm", (_spaces(norm) - 1).cast("long").alias("n_words"), _any(norm, roots).alias("gate"), *[F.when(norm.contains(f" {p} "), F.split(norm, rf" {p}(?= )", -1)).alias(f"p{i}") for i, (p, _) in enumerate(phrases)])
    n, first, last, labels = [], [], [], []
    for i, (p, label) in enumerate(phrases):
        parts = F.col(f"p{i}")
        n.append(F.when(parts.isNull(), F.lit(0).cast("long")).otherwise((F.size(parts) - 1).cast("long")))
        first.append(_spaces(F.element_at(parts, 1)).cast("long"))
        last.append((F.col("n_words") - (_spaces(F.element_at(parts, -1)) - 1) - len(p.split())).cast("long"))
        labels.append(F.when(parts.isNotNull(), F.lit(label)))
    total = n[0]
    for x in n[1:]:
        total = total + x
    kept = F.when(F.col("gate"), _resolved(_detections(norm, rules), [r[1] for r in rules]))
    shaped = F.transform(F.coalesce(kept, F.array().cast("array<struct<start:int,end:int,priority:int,rule:int,label:string>>")), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), (-x["priority"]).alias("priority"), x["label"].alias("label")))
    return d.select(id_col, "n_words", total.alias("n_base"), (F.least(*first) if len(first) > 1 else first[0]).alias("first_word"), (F.greatest(*last) if len(last) > 1 else last[0]).alias("last_word"), F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"), shaped.alias("detections"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.array_max(F.transform("detections", lambda x: x["priority"]))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda x: x["label"]))))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(best / F.lit(10.0), F.lit(0.0))).alias("score"),
    )
