"""Classifiers, language model, media, counts and packing."""

import collections
import hashlib
import itertools
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.llm import _learn, byte_cnn, gif, gru, language_id, lm_score, packing, token_counts, toxicity
from strophe.llm.gru import Gru
from tests.llm.brute import alnum_words, solid_words

DIR = "/root/testdata/sf0.01"


def test_codewords():
    for n in (0, 1, 2, 4, 9):
        code = language_id.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code}) == (n if n > 1 else min(n, 1))


def test_language_held_out(spark):
    got = language_id.op1_language_id(spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert r["ok"] >= 0.97 * r["n"]


def test_language_odd_rows(docs, empty):
    model = language_id.learn(docs)
    rows = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und"] * 4 and rows[0]["score"] == 0 and rows[10]["lang_pred"] != "und"
    assert language_id.predict(empty, language_id.learn(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.learn(empty)).collect()} == {"und"}


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    got = byte_cnn.op10_quality_classifier(spark, DIR).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_chunks_cover_whole_texts():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        s = byte_cnn.chunk_starts(n)
        seen = set().union(*(range(a, a + byte_cnn.CHUNK) for a in s.tolist()))
        assert set(range(n)) <= seen and (s % 2 == 0).all()


def test_packed_filters_equal_plain_ones():
    net = byte_cnn.Network()
    net.pack()
    data = np.random.default_rng(1).integers(0, 256, 3001).astype(np.uint8)
    plain = np.maximum(net.responses(byte_cnn.chunks_of(data, byte_cnn.chunk_starts(len(data)))).max(axis=1), 0)
    assert np.allclose(plain, net.pooled(data), atol=1e-4)


def test_packed_filters_are_not_broadcast(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)], "doc_id long, quality int")
    net = byte_cnn.learn(docs, labels, per_label=5)
    assert len(pickle.dumps(net)) < 1 << 20
    got = byte_cnn.score(docs.where("doc_id = 5"), net).first()["score"]
    assert len(pickle.dumps(net)) < 1 << 20 and math.isclose(got, net.score(np.frombuffer(b"One!", np.uint8)), abs_tol=1e-12)


def test_quality_odd_rows(spark, docs, empty, corpus):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = byte_cnn.score(docs, byte_cnn.learn(docs, labels, per_label=5)).collect()
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    none = labels.limit(0)
    assert byte_cnn.score(empty, byte_cnn.learn(empty, none)).count() == 0
    assert {r["predicted"] for r in byte_cnn.score(docs, byte_cnn.learn(docs, none)).collect()} == {1}


def plain_marks(x):
    """Marks of a clause (symbols without the end), rule by rule."""
    t = toxicity
    n = len(x)
    near = lambda i, sign, reach: sign in x[max(0, i - reach) : i]
    mark = ["-" if near(i, t.NOT, 3) else '"' if near(i, t.REPORT, 4) else "" for i in range(n)]
    threats = {}
    armed = [i for i in range(n) if x[i] == t.HARM and (i == 0 or near(i, t.INTENT, 3))]
    for i in range(n):
        before = [a for a in armed if i - 3 <= a < i]
        if x[i] == t.TARGET and before and t.TARGET not in x[before[-1] + 1 : i]:
            if i + 1 == n or x[i + 1] != t.PARTICLE:
                threats[i] = "threat" + mark[before[-1]]
    insult = [s in (t.INSULT, t.SLUR) for s in x]
    quiet = {t.DEGREE, t.NOT, t.INTENT, t.REPORT}

    def opened(i):  # someone is addressed right before i
        j = i - 1
        while j >= 0 and x[j] in quiet:
            j -= 1
        return j >= 0 and x[j] == t.TARGET

    def aimed(i):
        if opened(i):
            return True
        for j in range(i - 1, max(-1, i - 5), -1):
            if x[j] in (t.DEFINITE, t.TARGET):
                return False
            if x[j] == t.BEING and opened(j) or insult[j] and aimed(j):
                return True
        return False

    def single(i):
        return insult[i] and not aimed(i) and (x[i] == t.SLUR or not (i and x[i - 1] in (t.DEFINITE, t.DEGREE, t.BEING)))

    out = list(threats.values()) + ["address" + mark[i] for i in range(n) if insult[i] and aimed(i)]
    alone = [i for i in range(n) if single(i)]
    compound = n == 2 and x[0] == t.INSULT and not insult[1] and x[1] != t.TARGET
    if n <= 2 and alone and not compound:
        out.append("vocative" + mark[alone.pop(0)])
    loose = [i for i in alone if i or x[i] == t.SLUR]
    out += ["run" + mark[i] for i in loose if any(j < i for j in alone)]
    if loose:
        out.append("bare" + ("" if any(not mark[i] for i in loose) else mark[loose[0]]))
    return sorted(out)


def test_toxicity_grammar():
    f, rng = toxicity.grammar(), random.Random(8)
    words = [s for s in toxicity.SYMBOLS if s != toxicity.END]
    every = [list(x) for k in range(3) for x in itertools.product(words, repeat=k)]
    for x in every + [rng.choices(words, k=rng.randint(3, 14)) for _ in range(20_000)]:
        y = [*x, toxicity.END]
        got = f.run(y)
        for m in toxicity.machines():  # one after the other
            y = m.run(y)
        assert got == y and sorted(got) == plain_marks(x), x


@pytest.mark.parametrize("learned", [False, True])
def test_toxicity_needs_patterns(spark, learned):
    clean = ["The trash is collected on Monday.", "Take out the garbage.", "Kill the process.", "You take out the trash.", "They will destroy the evidence against them.", "He said: it was stupid.", "You are not an idiot."]
    clean += ["The trash is collected on Monday. Take out the garbage.", "The clown fish and the pig live here. The clown made us laugh.", "Garbage collection: garbage is freed. Trash is emptied.", "I will kill them off in chapter two."]
    toxic = ["You idiot", "You are such a pathetic loser.", "I will kill you.", "I am going to hurt you, moron.", "Idiot, moron, scum, clown, loser, trash and filth everywhere"]
    m = toxicity.Matcher(toxicity.seed_lexicon(), toxicity.grammar(), toxicity.WEIGHTS)
    if learned:
        m = toxicity.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, m).collect()}
    assert [got[i] for i in range(len(got))] == [0] * len(clean) + [1] * len(toxic)


def plain_toxicity(text, lexicon, weights):
    n = dict.fromkeys(toxicity.FEATURES, 0)
    stems = sorted((w[:-1] for w in lexicon if w.endswith("*")), key=lambda w: len(w.encode()))
    kind = lambda w: lexicon.get(w) or next((lexicon[p + "*"] for p in stems if w.startswith(p)), toxicity.OTHER)
    for clause in re.split(r"[.!?;:\n]", text or ""):
        for m in plain_marks([kind(w) for w in alnum_words(clause)]):
            n[m] += 1
    z = weights["constant"] + sum(weights[f] * math.log2(max(1, k) if f.startswith("bare") else 1 + k) for f, k in n.items())
    return 1 / (1 + math.exp(-z))


def test_quality_scores_whole_texts(docs, corpus):
    """The score of every chunk of a whole text by plain loops over filters."""
    net = byte_cnn.Network()
    rng = np.random.default_rng(2)
    net.c[...], net.shift = rng.normal(0, 0.5, net.c.shape), 0.3
    net.pack()
    got = {r["doc_id"]: r for r in byte_cnn.score(docs, net).collect()}
    for r in corpus:
        data = np.frombuffer((r[1] or "").encode(), np.uint8)
        starts, pooled = byte_cnn.chunk_starts(len(data)), []
        for a in starts.tolist():
            x = np.zeros(byte_cnn.CHUNK, np.uint8)
            x[: len(data[a : a + byte_cnn.CHUNK])] = data[a : a + byte_cnn.CHUNK]
            best = np.zeros(byte_cnn.FILTERS)
            for p in range(0, byte_cnn.CHUNK - byte_cnn.SPAN + 1, 2):
                best = np.maximum(best, sum(net.t[k][x[p + k]] for k in range(byte_cnn.SPAN)) + net.c)
            pooled.append(best)
            if len(data) > 50_000 and len(pooled) > 4:
                break
        if len(pooled) == len(starts):
            z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)]) @ net.u + net.v[0] + net.shift
            assert math.isclose(got[r[0]]["score"], 1 / (1 + math.exp(-z)), abs_tol=1e-4)
        assert got[r[0]]["predicted"] == (got[r[0]]["score"] >= 0.3)


def test_quality_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * (20 if i % 3 else 4000)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(60)], "doc_id long, quality int")
    seen = []
    keep = byte_cnn.Network.fit
    try:
        byte_cnn.Network.fit = lambda self, texts, y, **_: seen.append(sum(map(len, texts)))
        byte_cnn.learn(docs, labels, train_bytes=16 * 1024)  # the long ones are over a sixteenth
        byte_cnn.learn(docs, labels, train_bytes=1 << 24)
    finally:
        byte_cnn.Network.fit = keep
    assert seen == [40, 40 + 20 * len(byte_cnn.chunk_starts(20_000))]


def test_language_decoding(docs, corpus):
    """Distances by plain loops over bits, for whole texts; ties."""
    model = language_id.learn(docs.withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 9).cast("string"))))
    assert len(model.languages) > 7
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for r in corpus:
        if not re.search(r"[^\W\d_]", r[1] or ""):
            assert got[r[0]]["lang_pred"] == "und" and got[r[0]]["score"] == 0
            continue
        x = language_id.features(language_id.counts(np.frombuffer(r[1].encode(), np.uint8)))
        margin = x @ model.w + model.b
        far = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margin, code, strict=True)) / sum(model.trust) for code in model.code]
        assert math.isclose(far[model.languages.index(got[r[0]]["lang_pred"])], min(far), rel_tol=1e-4)
        assert got[r[0]]["ambiguous"] == (sorted(far)[1] - min(far) < 0.5)
    even = language_id.Model(np.zeros((4, language_id.WIDTH), np.float32), ["b", "a", "b", "a"])
    even.w[...], even.b[...] = 0, 0
    (row,) = language_id.predict(docs.where("doc_id = 6").limit(1), even).collect()
    assert row["lang_pred"] == "a" and row["ambiguous"] and row["score"] == 0.5


def test_too_many_labels_are_an_error(spark):
    rows = spark.range(30).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"))
    assert len(_learn.sample_by_label(rows, "lang", "doc_id", 5)[1]) == 30
    with pytest.raises(ValueError):
        _learn.sample_by_label(rows, "lang", "doc_id", 5, most_labels=29)


def test_many_languages_share_a_bound(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 40).cast("string").alias("lang"))
    drawn, counts = _learn.sample_by_label(rows, "lang", "doc_id", 500, most_rows=400)
    assert len(counts) == 40 and 200 < drawn.count() <= 800 and drawn.select("lang").distinct().count() == 40


def test_toxicity_scores_whole_texts(spark, docs, corpus):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(docs.select(F.col("doc_id") + 10**6, "text"))
    lexicon = toxicity.seed_lexicon() | {"ther*": toxicity.SLUR, "ka": toxicity.SLUR, "of": toxicity.INSULT}
    weights = toxicity.WEIGHTS | {"run": 0.4, "bare": 0.6, "address": 0.7, "constant": -5.0}
    rows = toxicity.score(own, toxicity.Matcher(lexicon, toxicity.grammar(), weights)).collect()
    assert len(rows) == own.count() and len({round(r["score"], 4) for r in rows}) > 20
    for r in rows:
        assert math.isclose(r["score"], plain_toxicity(r["text"], lexicon, weights), abs_tol=1e-9) and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op5_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.005


def test_toxicity_finds_planted(spark):
    rows = [(i, f"alpha beta zorgath{i % 7} gamma {i}. Zorgath{i % 5} delta." if i % 3 == 0 else f"alpha beta gamma delta {i}.", int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert got == {i: y for i, _, y in rows}


def test_toxicity_odd_rows(spark, docs, empty, corpus):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.learn(docs, none)
    assert toxicity.score(docs, m, spans=True).count() == len(corpus) and toxicity.score(empty, m).count() == 0
    assert {r["held_out"] for r in docs.where("doc_id is null").select(toxicity.held_out("doc_id", 4, 2).alias("held_out")).collect()} == {False}
    one = spark.createDataFrame([(1, "Fine. You idiot!")], "doc_id long, text string")
    (c,) = toxicity.score(one, m, spans=True).first()["clauses"]
    assert (c["start"], c["end"]) == (6, 15)


def test_gif_round_trip(spark, docs, corpus, empty):
    for p in (b"", b"a", b"ab" * 3000, bytes(range(256)) * 9, b"\xff" * 1152):
        q = gif.padded(p)
        assert b"".join(f.indices for f in gif.decode(gif.encode(q))) == q
    rows = {r["doc_id"]: r for r in gif.read_back(gif.store_texts(docs, keep=["doc_id"]), keep=["doc_id", "n_bytes"]).collect()}
    for r in corpus:
        q = gif.padded((r[1] or "").encode())
        got = rows[r[0]]
        assert (got["n_bytes"], got["payload_bytes"], got["payload_sha256"], got["tail_crc32"]) == (len((r[1] or "").encode()), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-32:]))
    assert gif.store_texts(empty).count() == 0
    f = gif.frames(gif.store_texts(docs.where("doc_id = 6"), keep=["doc_id"])).orderBy("frame").first()
    assert (f["width"], f["height"], f["delay_ms"], sum(f["histogram"])) == (24, 24, 40, 576)


def blob(pixels, w, h, bits=2, at=(0, 0), disposal=0, clear=None, interlaced=False):
    """A frame with codes after a clear for every pixel, as some writers do."""
    codes = [x for p in pixels for x in (1 << bits, p)] + [(1 << bits) + 1]
    value = n = 0
    for c in codes:
        value |= c << n
        n += bits + 1
    data = value.to_bytes((n + 7) // 8, "little")
    gce = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, 0, clear or 0, 0])
    head = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (*at, w, h)) + bytes([0x40 * interlaced, bits])
    return gce + head + b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\x00"


def file(*frames, w=2, h=2):
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\x81\x00\x00" + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255]) + b"".join(frames) + b"\x3b"


def test_gif_disposal_transparency_interlace():
    full = blob([1, 1, 1, 1], 2, 2)
    a, b = gif.decode(file(full, blob([2, 3], 2, 1, at=(0, 1), clear=3)))
    assert b.canvas[1].tolist() == [[0, 255, 0, 255], [255, 0, 0, 255]] and a.canvas[1, 0].tolist() == [255, 0, 0, 255] and a.delay_ms == 70
    *_, c = gif.decode(file(full, blob([2], 1, 1, disposal=2), blob([3], 1, 1, at=(1, 1))))
    assert c.canvas[0, 0].tolist() == [0, 0, 0, 0]
    *_, c = gif.decode(file(full, blob([2], 1, 1, disposal=3), blob([3], 1, 1, at=(1, 1))))
    assert c.canvas[0, 0].tolist() == [255, 0, 0, 255]
    (i,) = gif.decode(file(blob([0, 1, 2, 3, 1], 1, 5, interlaced=True), w=1, h=5))
    assert list(i.indices) == [0, 3, 2, 1, 1]  # rows 0, 4, 2, 1, 3 in the stream
    for bad in (b"", b"GIF89a", file(full)[:-5]):
        with pytest.raises(ValueError):
            list(gif.decode(bad))


def test_token_counts(spark, docs, corpus, empty):
    n = [len(token_counts.encoder().encode_ordinary(r[1])) if r[1] else 0 for r in corpus]
    sums = token_counts.with_sums(token_counts.histogram(docs))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == collections.Counter(n)
    for limit, r in rows.items():
        assert r["truncated_total"] == sum(min(limit, x) for x in n) and r["docs_longer"] == sum(x > limit for x in n) and r["tokens_total"] == sum(n)
    for limit in (0, 5, 50, 10**9):
        assert token_counts.truncated_total(sums, limit).first()[0] == sum(min(limit, x) for x in n)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.with_sums(token_counts.histogram(empty)).count() == 0


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))


def test_best_bounds():
    rng = random.Random(2)
    for _ in range(150):
        m = rng.randint(1, 8)
        lengths, counts, k = sorted(rng.sample(range(1, 50), m)), [rng.randint(1, 9) for _ in range(m)], rng.randint(1, 4)
        best = min(padding(lengths, counts, [*cut, lengths[-1]]) for r in range(min(k, m)) for cut in itertools.combinations(lengths[:-1], r))
        bounds = packing.best_bounds(lengths, counts, k)
        assert len(bounds) <= k and padding(lengths, counts, bounds) == best
    assert packing.best_bounds([], [], 3) == []


def batches(rows):
    key = lambda r: (r["bucket"], r["slice"], r["batch"])
    return [list(own) for _, own in itertools.groupby(sorted(rows, key=key), key=key)]


def test_packing(docs, corpus, empty):
    in_bytes = packing.pack(docs, length=packing.byte_length(F.col("text")), buckets=4, budget=2000, slice_batches=1).collect()
    in_tokens = packing.pack(docs, buckets=4, budget=2000, slice_batches=1).collect()
    encode = token_counts.encoder().encode_ordinary
    for rows, size in ((in_bytes, lambda t: len(t.encode())), (in_tokens, lambda t: len(encode(t)))):
        assert sorted(r["n_tokens"] for r in rows) == sorted(size(r[1] or "") + 1 for r in corpus)
        for own in batches(rows):
            assert len(own) == 1 or sum(r["pad_to"] for r in own) <= 2000
            assert sorted(r["place"] for r in own) == list(range(len(own))) and all(r["n_tokens"] <= r["pad_to"] for r in own)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_packing_deals_rows_of_one_id(spark, doc_id):
    docs = spark.range(20_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rows = packing.pack(docs, buckets=2, budget=400, slice_batches=8).collect()
    per_slice = collections.Counter((r["bucket"], r["slice"]) for r in rows)
    assert len(rows) == 20_000 and len(per_slice) > 10 and max(per_slice.values()) < 3 * 20_000 / len(per_slice)
    assert all(sum(r["pad_to"] for r in own) <= 400 and [r["doc_id"] for r in own] == [doc_id] * len(own) for own in batches(rows))


def test_packing_of_the_documents(spark):
    """What the batches hold, against a plain histogram and dynamic programme."""
    texts = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    n = collections.Counter(len(token_counts.encoder().encode_ordinary(t or "")) + 1 for t in texts)
    bounds = packing.best_bounds(sorted(n), [n[x] for x in sorted(n)], 16)
    rows = packing.op9_length_bucket_packing(spark, DIR).collect()
    assert collections.Counter((r["n_tokens"], r["pad_to"]) for r in rows) == {(x, min(b for b in bounds if b >= x)): k for x, k in n.items()}
    assert all(len(own) == 1 or sum(r["pad_to"] for r in own) <= 65_536 for own in batches(rows))


def test_gru_gradients():
    net = Gru(2, 3, 4)
    for p in net.params():
        p[...] = np.random.default_rng(p.size).normal(0, 0.4, p.shape)
    ids = np.array([[1, 2, 5, 0], [3, 0, 4, 4]])
    opens = np.array([[True, False, False], [False, True, False]])
    h = np.full((2, 4), 0.3, np.float32)

    def loss():
        s, total = h, 0.0
        for j in range(3):
            s = np.where(opens[:, j : j + 1], 0, s).astype(np.float32)
            s, _ = net.step(s, np.where(opens[:, j], net.begin, ids[:, j]))
            total -= net.log_prob(s, ids[:, j + 1]).sum()
        return total / 6

    grads, _ = net._window(h, ids, opens, True)
    for p, g in zip(net.params(), grads, strict=True):
        for k in np.argsort(-np.abs(g).ravel())[:4]:
            old, e = p.flat[k], 1e-2
            p.flat[k] = old + e
            up = loss()
            p.flat[k] = old - e
            down = loss()
            p.flat[k] = old
            assert abs((up - down) / (2 * e) - g.flat[k]) < 2e-3 + 0.05 * abs(g.flat[k])


def test_gru_gates_lie_together():
    """Each gate's values are one piece of memory, so a step is one loop over it."""
    net = Gru(2, 3, 4)
    after, values = net.step(np.zeros((5, 4), np.float32), np.arange(5))
    assert all(x.flags.c_contiguous for x in (after, *values)) and sum(x.size for x in values) >= 3 * after.size


def test_gru_windows_keep_no_values(monkeypatch):
    """Training in memory kept from window to window gives what new memory
    gives, and is made for the first window and the narrower last one only."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 6, n) for n in (1, 7, 40, 3, 150, 9)]
    made = []

    def kept(room, name, *shape, plain=gru._kept):
        made.append(room.get(name) is not (out := plain(room, name, *shape)))
        return out

    def new(room, name, *shape):
        return np.full(shape, np.nan, np.float32)

    got = []
    for memory in (kept, new):
        monkeypatch.setattr(gru, "_kept", memory)
        net = Gru(2, 3, 4)
        net.fit(texts, streams=2, window=8, epochs=1)
        got.append(net.params())
    assert all(np.array_equal(a, b) and np.isfinite(a).all() for a, b in zip(*got, strict=True))
    windows = -(-sum(map(len, texts)) // 2 // 8)
    assert windows > 10 and sum(made) * windows == 2 * len(made)  # the last window is narrower


def test_gru_scores_are_probabilities():
    net = Gru(2, 2, 4)
    every = [np.array(t) for t in itertools.product(range(4), repeat=3)]
    assert math.isclose(np.exp(net.score(every, window=2, group=10)).sum(), 1, rel_tol=1e-4)


def lm_counts(corpus, held):
    c = collections.Counter()
    for r in corpus:
        if not held(r[0]):
            c.update(solid_words(r[1]))
            c["\n"] += 1
    return c


def test_lm_base_is_exact(docs, corpus, empty):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = lm_score.score(docs, held, most_words=20, kinds=5, classes=4, per_class=4, start_texts=10).collect()
    c = lm_counts(corpus, lambda d: d is not None and zlib.crc32(str(d).encode()) % 3 == 0)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*solid_words(t), "\n"])
    want = sorted((len(solid_words(r[1])) + 1, sum(c[w] > 0 for w in [*solid_words(r[1]), "\n"]), n, round(base(r[1]), 4)) for r in corpus)
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert lm_score.score(empty, held).count() == 0
    untrained = lm_score.score(docs, F.lit(True)).collect()
    assert len(untrained) == len(corpus) and all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in untrained)


def test_lm_score_by_any_groups(docs, monkeypatch):
    """Scores and their rows are the same whatever blocks texts are read in and
    however many are scored at once."""
    docs = docs.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("held_out")).fillna(False)
    tables, counts = lm_score.fit(docs.where(~F.col("held_out")), most_words=40, kinds=5, classes=4, per_class=5, start_texts=10)
    found = []
    for scan, most in ((lm_score.SCAN, lm_score.SCORE), (50, 100), (50, 10**6)):
        monkeypatch.setattr(lm_score, "SCAN", scan)
        monkeypatch.setattr(lm_score, "SCORE", most)
        rows = lm_score.apply(docs, tables, counts).collect()
        found.append(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows))
    assert len(found[0]) > 10
    for other in found[1:]:
        assert [x[:4] for x in other] == [x[:4] for x in found[0]]
        np.testing.assert_allclose([x[4:] for x in other], [x[4:] for x in found[0]], rtol=1e-5, atol=1e-3)


def test_lm_score_of_whole_texts(docs, corpus):
    """Word by word, through the whole text, with exact counts of the words
    beyond the vocabulary."""
    docs = docs.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("held_out")).fillna(False)
    kinds = 5
    tables, counts = lm_score.fit(docs.where(~F.col("held_out")), most_words=40, kinds=kinds, classes=4, per_class=5, start_texts=10)
    got = {r["doc_id"]: r["score"] for r in lm_score.apply(docs, tables, counts).collect()}
    c = lm_counts(corpus, lambda d: d is not None and d % 3 == 0)
    assert len(tables.vocab) == 14

    def code(w):
        if w == "\n":
            return lm_score.END, 0
        data = np.frombuffer(w.encode(), np.uint8)
        h, _, kind = lm_score.tokens(data, np.array([0, len(data)]), kinds)
        return h[0], int(kind[0])

    codes = {w: code(w) for r in corpus for w in solid_words(r[1])}
    beyond = {w for w in c if w != "\n" and codes[w][0] not in tables.vocab}
    # within a kind, all words beyond the vocabulary and one more have probability one
    for k in range(kinds):
        own = [c[w] for w in beyond if codes[w][1] == k]
        assert math.isclose(sum(x + 0.1 for x in own) + 0.1, 10 ** tables.kind_floor[k], rel_tol=1e-9)
    for r in corpus:
        h, last, total = np.zeros((1, tables.net.hidden), np.float32), np.array([tables.net.begin]), 0.0
        for w in [*solid_words(r[1]), "\n"]:
            key, kind = codes.get(w) or code(w)
            ids, out = tables.ids(np.array([key]), np.array([kind]))
            assert out[0] == (w != "\n" and key not in tables.vocab)
            h, _ = tables.net.step(h, last)
            total += tables.net.log_prob(h, ids)[0] / math.log(10) + (math.log10(c[w] + 0.1) - tables.kind_floor[kind] if out[0] else 0)
            last = ids
        assert math.isclose(got[r[0]], total, rel_tol=1e-4, abs_tol=1e-3), (r[0], (r[1] or "")[:40])


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_lm_beats_the_base(spark, size):
    rows = lm_score.op7_lm_scoring(spark, f"/root/testdata/{size}").where("held_out")
    r = rows.agg(F.sum("n_tokens").alias("n"), F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.max("score").alias("most")).first()
    # better than a uniform guess over 10,000 words, too
    assert r["score"] / r["n"] > r["base"] / r["n"] + 0.3 and r["score"] / r["n"] > -4 and r["most"] < 0


def test_lm_learns_from_all_texts(spark):
    """The network learns word pairs that only texts beyond the start have."""
    rng = random.Random(5)
    pairs = [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(6000)]
    docs = spark.createDataFrame([*enumerate(texts), (10_000, "a b c d e f g h"), (10_001, "b a d c f e h g")], "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in lm_score.score(docs, F.col("doc_id") >= 10_000, kinds=1, classes=3, per_class=4, start_texts=1).collect()}
    assert rows[10_000]["score"] > rows[10_001]["score"] + 0.5 and math.isclose(rows[10_000]["base_score"], rows[10_001]["base_score"], abs_tol=1e-9)


def test_lm_sums_of_many_tasks(spark, monkeypatch):
    """Tasks' networks are summed two at a time to what one sum gives."""
    texts = spark.createDataFrame([(f"w{i % 7} w{i % 5} w{i % 3} " * 20,) for i in range(45)], "text string").repartition(9)
    tables, _ = lm_score.fit(texts, kinds=1, classes=2, per_class=4, start_texts=1, rounds=0)
    shared = spark.sparkContext.broadcast(tables)
    flat = lm_score._learn(texts, "text", shared)
    monkeypatch.setattr(lm_score, "FAN", 2)
    assert np.allclose(flat, lm_score._learn(texts, "text", shared), rtol=1e-9, atol=1e-12) and len(flat)


def test_lm_frequent_tokens(spark):
    counts = spark.createDataFrame([(i, 0, n) for i, n in enumerate([1, 1, 1, 2, 2, 5, 70, 1000, 1001])], "hash long, kind int, n long")
    for most, want in ((0, []), (1, []), (2, [1000, 1001]), (4, [5, 70, 1000, 1001]), (5, [5, 70, 1000, 1001]), (6, [2, 2, 5, 70, 1000, 1001]), (99, [1, 1, 1, 2, 2, 5, 70, 1000, 1001])):
        assert sorted(lm_score._frequent(counts, most)[2].tolist()) == want


def test_lm_trains_where_the_end_is_rare(spark):
    text = "aab aab aab bba bba " + " ".join(f"ab{i}" for i in range(40))
    docs = spark.createDataFrame([(0, text), (1, "ab1"), (2, "zz")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_score.score(docs, F.col("doc_id") > 0, most_words=2, kinds=2, classes=2, per_class=2).collect()}
    assert rows[0]["train_tokens"] == 46 and rows[1]["n_known"] == 2 and rows[2]["n_known"] == 1 and rows[1]["score"] < 0
