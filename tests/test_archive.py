"""The last look at closed sessions, the cache of results, MIDI as a source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.operators import evaluation as E
from strophe.operators import harmony as H
from strophe.operators.sessions import closing
from strophe.sources import midi
from strophe.sources.midi_source import MidiSource
from strophe.streaming import closing as Z
from strophe.streaming import refresh as R
from tests.test_refresh import comparable, song, table


@pytest.fixture(scope="module")
def run(spark):
    rows = song(1, 40, 1, begin=8.0) + song(2, 30, 2) + song(3, 8, 3) + [(4, None, 0.0, 25.0, 60, 0.5)]
    notes = table(spark, rows).persist()
    log = R.replayed(notes).persist()
    return notes, log


def test_finished_sessions(spark, run, tmp_path):
    notes, log = run
    rows = Z.finished(log, notes).persist()
    fates = {r["session_id"]: r for r in closing(notes).collect()}
    assert {r["session_id"] for r in rows.select("session_id").distinct().collect()} == {i for i, r in fates.items() if r["fate"] == "archived"} == {1, 2, 4}
    assert fates[1]["lead_s"] > 7
    for i in (1, 2):
        own, length = rows.where(F.col("session_id") == i), fates[i]["duration_s"]
        for kind in ("key", "chord"):
            s = own.where(F.col("kind") == kind).orderBy("start_s").collect()
            assert s[0]["start_s"] == 0 and s[-1]["end_s"] == pytest.approx(length)
            assert all(a["end_s"] == pytest.approx(b["start_s"]) for a, b in zip(s, s[1:], strict=False))
        assert own.where("kind = 'note'").agg(F.max("end_s")).first()[0] == pytest.approx(length)
        assert own.where("kind = 'tempo'").agg(F.max("start_s")).first()[0] <= length
    # the tail is that of the whole session's last 24 seconds; the rest is what refreshes left
    own = rows.where("session_id = 2 and kind = 'key'").orderBy("start_s").collect()
    frames = H.chroma(notes.where("session_id = 2 and end_s > 6").withColumn("event_id", F.lit(1)))
    assert own[-1]["name"] == H.key_segments(frames).orderBy(F.desc("start_s")).first()["key"]
    before = Z.shifted(R.current(log), closing(notes)).where("session_id = 1 and kind = 'chord' and end_s < 20")
    kept = rows.where("session_id = 1 and kind = 'chord' and end_s < 20").drop("kind")
    assert comparable(before.drop("kind").collect()) == comparable(kept.collect()) and kept.count() > 5
    (only,) = rows.where("session_id = 4 and kind = 'note'").collect()
    assert (only["number"], only["end_s"]) == (60, 25.0)
    # a commit that was cut off and runs again leaves one archive; other sessions stay
    folder = str(tmp_path / "archive")
    Z.commit(rows.where("session_id <> 2"), folder)
    Z.commit(rows.limit(5), folder)
    Z.commit(rows, folder)
    Z.commit(rows.where("session_id = 1"), folder)
    assert comparable(spark.read.parquet(folder).select(*rows.columns).collect()) == comparable(rows.collect())


def test_finished_without_rows(spark, run):
    notes, log = run
    assert Z.finished(log.where("false"), notes.where("false")).count() == 0
    assert {r[0] for r in Z.finished(log, notes, automatic=False).select("session_id").distinct().collect()} == {1, 2, 3, 4}


def one(x):
    return x + 1


def two(x):
    return x + 2


def test_fingerprint():
    assert E.fingerprint(one, two, step=1.5) == E.fingerprint(two, one, step=1.5)
    prints = [E.fingerprint(one), E.fingerprint(two), E.fingerprint(one, two), E.fingerprint(one, step=1.5), E.fingerprint(one, step=1.0), E.fingerprint(np.fft.rfft, midi)]
    assert len(set(prints)) == len(prints)


def test_cache(spark, tmp_path):
    folder, seen = str(tmp_path), []

    def compute(factor):
        def f(files):
            seen.append(sorted(r["path"] for r in files.collect()))
            return files.select("path", (F.col("size") * factor).alias("result"))

        return f

    files = lambda *rows: spark.createDataFrame(rows, "path string, size long, modified long")
    get = lambda f, v, factor: {r["path"]: r["result"] for r in E.refreshed_cache(f, folder, v, compute(factor)).collect()}
    assert get(files(("a", 1, 1), ("b", 2, 1)), "v1", 10) == {"a": 10, "b": 20} and seen == [["a", "b"]]
    assert get(files(("a", 1, 1), ("b", 2, 1)), "v1", 99) == {"a": 10, "b": 20} and len(seen) == 1
    assert get(files(("a", 1, 1), ("b", 3, 2), ("c", 4, 1)), "v1", 10) == {"a": 10, "b": 30, "c": 40} and seen[1] == ["b", "c"]
    assert get(files(("b", 3, 2)), "v1", 99) == {"b": 30} and len(seen) == 2
    assert get(files(("a", 1, 1)), "v2", 7) == {"a": 7} and seen[2] == ["a"]  # a changed kernel
    assert get(files(), "v3", 7) == {}


EVENTS = "session_id string, tick long, kind string, pitch int, velocity int, tempo_us long, text string"


def test_midi_source(spark, tmp_path):
    spark.dataSource.register(MidiSource)
    rows = [(s, 480 * k + d, kind, 60 + k, 80, None, None) for s in ("a", "b/c", "d") for k in range(3) for d, kind in ((0, "on"), (400, "off"))]
    rows += [("a", 0, "tempo", None, None, 400_000, None), ("a", 0, "marker", None, None, None, "BEAT 1")]
    events = spark.createDataFrame(rows, EVENTS)
    folder = str(tmp_path / "out")
    events.repartition(3, "session_id").write.format("midi").mode("append").save(folder)
    got = spark.read.format("midi").option("partitionBytes", "60").load(folder)
    want = midi.read(spark, folder)
    plain = lambda d: comparable((r["path"].rsplit("/", 1)[-1], *r[1:]) for r in d.collect())
    assert got.schema == want.schema and plain(got) == plain(want) and got.rdd.getNumPartitions() == 3
    assert sorted({r[0] for r in plain(got)}) == ["a.mid", "b%2Fc.mid", "d.mid"] and got.where("kind = 'on'").count() == 9
    (tmp_path / "out" / "bad.mid").write_bytes(b"nothing")
    assert [r["text"] for r in spark.read.format("midi").load(folder).where("kind = 'error'").collect()] == ["not a MIDI file"]
    events.where("session_id = 'd'").coalesce(1).write.format("midi").mode("overwrite").save(folder)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d.mid"]


def test_failed_midi_writes_leave_nothing(spark, tmp_path):
    spark.dataSource.register(MidiSource)
    folder = tmp_path / "none"
    good = [(s, 0, "on", 60, 80, None, None) for s in "abcdef"]
    bad = [("g", 0, "marker", None, None, None, "一")]  # no latin-1
    with pytest.raises(Exception, match="latin-1|Python|failed"):
        spark.createDataFrame(good + bad, EVENTS).repartition(3, "session_id").write.format("midi").mode("append").save(str(folder))
    assert not [p for p in folder.iterdir() if p.suffix == ".mid"]
    split = spark.createDataFrame([("a", k, "on", 60, 80, None, None) for k in range(8)], EVENTS).repartition(4)
    with pytest.raises(Exception, match="repartition|Python|failed"):
        split.write.format("midi").mode("append").save(str(folder))
    assert not [p for p in folder.iterdir() if p.suffix == ".mid"]
