"""Decontamination, near duplicates and license scan against brute force."""

import hashlib
import re
from collections import Counter
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pytest

from strophe.llm import decontaminate, graph, jaccard_join, license_rules, license_scan
from strophe.llm.license_rules import rules
from tests.llm.brute import alnum_words, classes, hits, shingle_set


def items_of(corpus):
    w = (corpus[6][1]).split()
    return [(1, " ".join(w[10:40])), (1, " ".join(w[10:40])), (2, "ONE"), (3, None), (4, ""), (None, " ".join(w[80:95])), (11, "straße 漢字"), (5, "never seen words here")]


@pytest.mark.parametrize("block_words", [1_000_000, 25])
def test_decontamination(spark, docs, corpus, block_words):
    items = items_of(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_contamination(docs.select("doc_id", "text"), bench, block_words=block_words)).collect()
    want = []
    for r in corpus:
        n, marked, found = hits(r[1], items)
        want.append((r[0], n, len(marked), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(marked)))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_decontamination_without_rows(spark, docs, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.find_contamination(docs, bench)).where("contaminated").count() == 0
    assert decontaminate.find_contamination(empty, bench).count() == 0


def same(spark, rows):
    got = jaccard_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    best = classes(rows)
    want = [(d, len(shingle_set(t)), c) for (d, t), c in zip(rows, best, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_jaccard(spark, corpus):
    same(spark, [(r[0], r[1]) for r in corpus])


def family(seed, n=60, size=60, edits=8):
    """Edited copies around the threshold, so that some link and some don't."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = list(rng.choice(vocabulary, size))
    rows = []
    for i in range(n):
        w = list(base)
        for p in rng.integers(0, size, rng.integers(0, edits)):
            w[p] = str(rng.choice(vocabulary))
        rows.append((i, " ".join(w)))
    passage = " ".join(rng.choice(vocabulary, 12))
    return rows + [(n + i, " ".join(rng.choice(vocabulary, 30)) + " " + passage) for i in range(30)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_families(spark, seed):
    same(spark, family(seed))


def test_jaccard_large_clusters(spark, monkeypatch):
    """Pieces of a large cluster, and shingles too common to screen."""
    monkeypatch.setattr(jaccard_join, "PIECE", 500)
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    same(spark, family(3, n=80))


def test_jaccard_sets_of_large_clusters_are_not_written(spark, monkeypatch):
    """Pieces are joined from the texts; files hold no sets."""
    written, plain = [], jaccard_join.checkpoint
    monkeypatch.setattr(jaccard_join, "checkpoint", lambda df: written.append(df.columns) or plain(df))
    monkeypatch.setattr(jaccard_join, "PIECE", 500)
    rows = family(6, n=80)
    # one class over many pieces
    same(spark, rows + [(1000 + i, f"{rows[0][1]} end{i}") for i in range(60)])
    assert len(written) > 5 and not any("shingles" in columns for columns in written)


def test_jaccard_groups_by_place_and_size(spark):
    """Sets that share a prefix shingle are a group only if they may link by
    their sizes and by what follows it."""
    rng = np.random.default_rng(8)
    words = lambda n: [str(x) for x in rng.integers(0, 10**9, n)]
    passage, base = words(5), words(100)
    rows = [(1, passage + words(60)), (2, passage + words(600)), (3, base + words(8)), (4, base + words(9))]
    rows = [(d, " ".join(w)) for d, w in rows]
    # the passage is first in the order, so in both prefixes
    sets = dict(jaccard_join.text_sets(pa.array([t for _, t in rows])))
    others = np.unique(np.concatenate([np.setdiff1d(s, np.intersect1d(sets[0], sets[1])) for s in sets.values()]))
    ranks = spark.sparkContext.broadcast(jaccard_join._Ranks(others, np.full(len(others), 2)))
    routed = jaccard_join._route(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ranks, 3)
    groups = routed.groupBy("bucket").applyInArrow(jaccard_join._meet, "gid long, sids array<long>").where("gid is not null").collect()
    ids = [jaccard_join.set_id(sets[i]) for i in range(4)]
    assert groups and all(sorted(r["sids"]) == sorted(ids[2:]) for r in groups)
    same(spark, rows)


def test_jaccard_places_lose_no_link():
    rng = np.random.default_rng(9)
    n = np.concatenate([rng.integers(1, 60, 4000), np.exp(rng.uniform(0, 16, 4000)).astype(np.int64)])
    m = np.maximum(1, (n * rng.uniform(0.7, 1.4, len(n))).astype(np.int64))
    i, j = (np.array([rng.integers(0, jaccard_join.prefix_length(int(x))) for x in k]) for k in (n, m))
    both = np.concatenate([n, m])
    size = (np.searchsorted(jaccard_join._STEPS, both, side="right") - 1).astype(np.uint8)
    place = np.minimum(np.concatenate([i, j]) * jaccard_join._PLACES // both, 255).astype(np.uint8)
    kept = jaccard_join._can_link(size, place, np.arange(len(n)), np.arange(len(n)) + len(n))
    can = np.minimum(n - i, m - j) >= jaccard_join.need(n, m)
    assert (kept | ~can).all() and can.any() and not kept.all()


def test_jaccard_shingles_common_over_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST", 5)
    same(spark, family(5, n=80))


def test_jaccard_order_reaches_the_driver_packed(spark, monkeypatch):
    """Common shingles come as a row a bucket, each with its share of the most
    common ones."""
    rows = family(7, n=80)
    survey = jaccard_join._survey(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 4)
    texts = {frozenset(shingle_set(t)) for _, t in rows}
    want = sorted((n for n in Counter(g for s in texts for g in s).values() if n > 1), reverse=True)
    for most in (1_000_000, 40):
        monkeypatch.setattr(jaccard_join, "COMMON", most)
        got = jaccard_join._common(survey, 4).collect()
        counts = [np.frombuffer(r["counts"], np.int64).tolist() for r in got]
        assert len(got) <= 4 and all(len(r["shingles"]) == 8 * len(c) for r, c in zip(got, counts, strict=True))
        assert all(len(c) <= most // 4 for c in counts)
        if most > len(want):
            assert sorted(sum(counts, []), reverse=True) == want
        else:
            assert max(max(c) for c in counts) == want[0] and all(c == sorted(c, reverse=True) for c in counts)
    same(spark, rows)


def test_components_of_stars_take_no_step(spark, monkeypatch):
    steps, plain = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: steps.append(1) or plain(df))

    def roots(edges):
        steps.clear()
        return dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))

    stars = [(1, 9), (8, 1), (1, 7), (-5, 2), (2, -5), (3, 3), (None, 4)]
    assert roots(stars) == {1: 1, 9: 1, 8: 1, 7: 1, -5: -5, 2: -5} and len(steps) == 1
    # one node of two centres, a chain, and a star around its largest node
    for edges in ([(1, 9), (2, 9), (1, 5)], [(1, 2), (2, 3), (3, 4)], [(9, 1), (9, 2), (9, 5)]):
        assert set(roots(edges).values()) == {1} and len(steps) > 1
    assert roots([]) == {}


def test_jaccard_without_rows(spark, empty):
    assert jaccard_join.similar_classes(empty).count() == 0


def test_rtree_misses_nothing():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, rng.integers(5, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(300)]
    found = jaccard_join.join_cluster(sets, np.arange(300))
    up = list(range(300))

    def top(x):
        return x if up[x] == x else top(up[x])

    for i in range(300):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
    groups = lambda x: sorted(sorted(i for i in range(300) if x[i] == v) for v in set(x))
    assert groups(found.tolist()) == groups([top(i) for i in range(300)])


TEXTS = [
    None,
    "",
    "Under the MIT License, under the mit-license!",
    "the Apache License, Version 2.0 (the License) and CC BY-NC 4.0",
    "SPDX-License-Identifier: GPL-3.0-or-later",
    "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "as is the case here",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. All rights reserved.",
]


def test_license_base_and_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = alnum_words(t)
        places = [k for p, _ in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
    labels = {i: [d["label"] for d in r["detections"]] for i, r in got.items()}
    assert labels[2] == ["mit", "mit"] and labels[4] == ["gpl-3.0-or-later"] and labels[5] == ["gpl-2.0-or-later"]
    assert "apache-2" in labels[3] and "cc-by-nc" in labels[3] and labels[6] == [] and labels[7] == ["bsd", "proprietary"]


def test_license_rules(spark):
    assert len(rules()) >= 200 and len({r[3] for r in rules()}) == len(rules())
    with pytest.raises(ValueError):
        license_scan.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"), phrases=(("a b a", "x"),))


def plain_detections(text, own):
    """All matches, without those inside of one of the same or a higher priority."""
    norm = " " + "".join(w + " " for w in alnum_words(text))
    found = [(m.start(), m.end(), priority, i, license_rules.identifiers()[m[0][len(license_rules.TAG) :]] if label == license_rules.NAMED else label) for i, (label, priority, keyword, pattern) in enumerate(own) if keyword in norm for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", norm)]

    def gone(d):
        return any(e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and ((e[0], e[1]) != (d[0], d[1]) or (-e[2], e[3]) < (-d[2], d[3])) for e in found)

    return sorted((d[0], d[1], d[2], d[4]) for d in found if not gone(d))


def agree(spark, texts, own=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: sorted(map(tuple, r["detections"])) for r in license_scan.scan(docs, rules=own).collect()}
    want = {i: plain_detections(t, own or rules()) for i, t in enumerate(texts)}
    assert got == want
    return want


def test_license_resolution_of_random_intervals(spark):
    rng = np.random.default_rng(6)
    letters = "abcdef"
    own = [(f"r{i}", int(rng.integers(1, 5)), "a", " ".join("".join(rng.choice(list(letters), 1)) if rng.random() < 0.7 else "[a-f]" for _ in range(rng.integers(1, 6)))) for i in range(40)]
    found = agree(spark, ["", "b", *(" ".join(rng.choice(list(letters), rng.integers(1, 90))) for _ in range(60))], own)
    assert sum(map(len, found.values())) > 500


def test_license_overlaps_stay(spark):
    own = [("a", 5, "w", "w1 w2 w3 w4"), ("c", 7, "w", "w4 w5"), ("d", 5, "w", "w5 w6"), ("e", 5, "w", "w2 w3"), ("f", 9, "w", "w3"), ("g", 9, "w", "w3")]
    found = agree(spark, ["w1 w2 w3 w4 w5 w6"], own)
    assert [x[3] for x in found[0]] == ["a", "f", "c", "d"]
    assert {x[3] for x in agree(spark, ["Copyright 2020 Acme All Rights Reserved."])[0]} == {"copyright-notice", "proprietary"}


def test_license_random_texts(spark):
    rng = np.random.default_rng(7)
    made = [x for r in rules()[1:] for x in forms(parser.parse(r[3]))] + [license_rules.TAG + x for x in license_rules.identifiers()]
    texts = []
    for _ in range(150):
        parts = [str(rng.choice(made)) if rng.random() < 0.7 else " ".join(rng.choice(["the", "of", "under", "license", "version", "2", "0", "or", "x"], rng.integers(1, 6))) for _ in range(rng.integers(1, 12))]
        texts.append(rng.choice([" ", "-", ". ", "\n"]).join(parts).title())
    texts.append(" ".join(str(rng.choice(made)) for _ in range(2500)))  # very long, thousands of detections
    assert sum(map(len, agree(spark, texts).values())) > 2000


def test_license_odd_rows(docs, empty, corpus):
    assert license_scan.scan(docs).count() == len(corpus) and license_scan.scan(empty).count() == 0


def forms(tree):
    """Texts that match an expression: each alternative, with and without each optional part."""
    out = [""]
    for op, av in tree:
        if op is sre.LITERAL:
            own = [chr(av)]
        elif op is sre.NOT_LITERAL:
            own = ["z"]
        elif op is sre.IN:
            kind, x = av[0]
            own = [chr(x if kind is sre.LITERAL else x[0])]
        elif op is sre.ASSERT_NOT:
            own = [""]
        elif op is sre.SUBPATTERN:
            own = forms(av[3])
        elif op is sre.BRANCH:
            own = [x for part in av[1] for x in forms(part)]
        else:
            assert op is sre.MAX_REPEAT
            own = [x * k for k in {av[0], min(av[0] + 1, av[1])} for x in (forms(av[2]) if k else [""])]
        out = [a + b for a in out for b in own]
    return out


def test_license_keywords_are_in_every_match():
    for label, _, keyword, pattern in rules():
        made = forms(parser.parse(pattern))
        assert all(re.fullmatch(pattern, x) for x in made)
        # this sentence is the Apache license's only where its name stands
        assert all(keyword in x for x in made) or (label, keyword) == ("apache-2", "licensed under the apache")


def test_license_optional_forms(spark):
    texts = {"See the LICENSE file for details.": "unknown-license", "X Consortium License": "x11", "Llama 3 Community License": "llama-community", "open rail-m license": "openrail", "OpenRAIL-M": "openrail", "X11 license": "x11", "see license for more information": "unknown-license"}
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: [d["label"] for d in r["detections"]] for r in rows} == {i: [x] for i, x in enumerate(texts.values())}
