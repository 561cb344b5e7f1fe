"""The prefix trie against a plain one, block cuts included."""

import hashlib
import zlib

import numpy as np
import pytest

from strophe.llm import prefix_trie


def plain(rows):
    """Nodes of the trie of (conv_id, turn, role, text) rows."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in own:
        own[c] = [t[2:] for t in sorted(own[c], key=lambda t: (*t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))]
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = (own.get(c - c % 100, [])[:h] if c >= 0 else []) + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path)))
    out = {}
    for node in sorted(members, key=len, reverse=True):
        m = members[node]
        below = [out[k] for k in members if len(k) == len(node) + 1 and k[:-1] == node]
        saved = (len(m) - 1) * len(node[-1][1]) if node else 0
        ends = ",".join(map(str, sorted(c for c, n in m if n == len(node))))
        out[node] = [min(c for c, _ in m), len(node), None, len(m), len(below), sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest()]
    for node, row in out.items():
        if node:
            row[2] = out[node[:-1]][0]
    return sorted(map(tuple, out.values()), key=str)


def some(seed, n, vocabulary, long=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(n):
        for k in range(int(rng.integers(1, long))):
            rows.append((int(c), k, ["user", "bot", None][k % 3], str(vocabulary[rng.integers(0, len(vocabulary))])))
    return rows


def check(spark, rows):
    table = spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, path string, depth int").repartition(3)
    got = [tuple(r) for r in prefix_trie.trie(prefix_trie.paths(table)).collect()]
    assert sorted(got, key=str) == plain(rows)


ODD = [(5, None, None, None), (5, 0, "user", "a"), (5, 0, "user", "b"), (5, 0, "user", "b"), (None, 1, "user", "lost"), (7, 1, "", ""), (107, 1, "x", "Über \U0001f600"), (100, 1, "user", None), (305, 1, "u", "only base misses"), (400, 2, "u", "z" * 5000)]


@pytest.mark.parametrize("rows", [[], [(1, 0, "u", "x")], ODD, ODD + some(1, 250, ["", "a", "ab", "c"]), [(c, k, "u", "same") for c in range(700) for k in range(3)] + some(2, 120, ["same", "b"], 9)])
def test_trie(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_many_blocks(spark, monkeypatch, seed):
    """Three levels of merging, blocks of few paths and of none."""
    monkeypatch.setattr(prefix_trie, "FAN", 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        check(spark, some(seed, 260, ["a", "b", "c"][: seed + 1], 7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
