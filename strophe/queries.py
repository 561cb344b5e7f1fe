"""The registered queries over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.functions import music as M
from strophe.operators import beats as B
from strophe.operators import display as D
from strophe.operators import evaluation as E
from strophe.operators import grouping as G
from strophe.operators import harmony as H
from strophe.operators import intervals as I
from strophe.operators import kernels as K
from strophe.operators import sessions as Z
from strophe.operators import signal as S
from strophe.operators import tempo as T
from strophe.operators import timing as X
from strophe.operators import tracking as Y
from strophe.operators import transcription as A
from strophe.plans import views as V
from strophe.sources import export, midi, synthetic
from strophe.sources import settings as Settings
from strophe.streaming import closing as L
from strophe.streaming import refresh as R

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql if sql.lstrip().startswith("with") else V.SQL + sql
        return f

    return put


def _inside(name: str) -> str:
    """A query's SQL as a table, its numbers (nearly) as they were before rounding."""
    return "(" + SQL[name].replace(", 6)", ", 14)").replace(", 9)", ", 14)") + ")"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _notes(spark, d):
    return V.notes(V.read(spark, d))


def _tempo(spark, d):
    return V.tempo(V.read(spark, d))


def _beats(spark, d):
    return V.beats(V.read(spark, d))


SEGMENTS = """, l as (select *, lag(bpm) over (partition by session_id order by time_s, event_id) as b from tempo),
seg as (select session_id, event_id, time_s, bpm, confidence, sum(case when abs(bpm - b) >= greatest(8, 0.08 * least(abs(bpm), abs(b))) then 1 else 0 end)
  over (partition by session_id order by time_s, event_id rows unbounded preceding) as segment from l)"""
POOLED = SEGMENTS + """, sp as (select *, time_s - lag(time_s) over (partition by session_id, segment order by time_s, event_id) as step from seg),
st as (select session_id, segment, case when count(*) < 2 then 0 else max(time_s) - min(time_s) + coalesce(median(step) filter (step > 1e-6), 0) end as dur, var_pop(bpm) as v from sp group by all),
sw as (select *, case when count(*) over (partition by session_id) > 1 and dur < 10 then 0 else dur end as w from st),
pooled as (select session_id, case when sum(w) <= 1e-9 then 0 else sqrt(greatest(0, sum(w * v) / sum(w))) end as bpm_std from sw group by 1)"""


@query("tempo_jump_segments", SEGMENTS + " select session_id, event_id, round(time_s, 6) as time_s, cast(segment as int) as segment from seg")
def _(spark, d):
    return _rounded(T.jump_segments(_tempo(spark, d)).select("session_id", "event_id", "time_s", "segment"))


@query("tempo_pooled_std", POOLED + " select session_id, round(bpm_std, 6) as bpm_std from pooled")
def tempo_pooled_std(spark, d):
    return _rounded(T.pooled_std(_tempo(spark, d)))


@query("tempo_causal_mean_30s", SEGMENTS + """ select session_id, event_id, round(avg(bpm) over (partition by session_id, segment order by time_s range between 30 preceding and current row), 6) as bpm_mean from seg""")
def _(spark, d):
    return _rounded(T.causal_mean(_tempo(spark, d)).select("session_id", "event_id", "bpm_mean"))


@query("tempo_summary", POOLED + """ select session_id, round(avg(bpm), 9) as average_bpm, round(min(bpm), 9) as min_bpm, round(max(bpm), 9) as max_bpm, round(any_value(bpm_std), 9) as bpm_std,
  case when max(bpm) - min(bpm) < 0.05 then 'constant-grid locked' else 'incremental segmented' end as mode from tempo join pooled using (session_id) group by 1""")
def _(spark, d):
    return _rounded(T.summary(_tempo(spark, d)), 9)


@query("current_bpm", ", x as (select session_id, coalesce(max_by(bpm, time_s) filter (time_s <= 20.05), avg(bpm)) as bpm from tempo group by 1) select session_id, round(bpm, 6) as bpm from x")
def _(spark, d):
    return _rounded(T.current_bpm(_tempo(spark, d), 20.0))


@query("dedup_round_time", """, x as (select *, row_number() over (partition by session_id, round_even(time_s, 1) order by abs(log2(bpm / 120)), confidence desc, event_id desc) as r from tempo)
select session_id, event_id, round(bpm, 6) as bpm from x where r = 1""")
def _(spark, d):
    return _rounded(T.dedup_rounded(_tempo(spark, d), 120.0, 1).select("session_id", "event_id", "bpm"))


@query("topk_last", ", x as (select *, row_number() over (partition by session_id order by time_s desc, event_id desc) as recent from tempo) select session_id, event_id, cast(recent as int) as recent, round(bpm, 6) as bpm from x where recent <= 12")
def _(spark, d):
    return _rounded(T.last_k(_tempo(spark, d)).select("session_id", "event_id", "recent", "bpm"))


@query("tempo_fold_octave", """, c as (select session_id, event_id, bpm, unnest([{'far': abs(log2(bpm * 0.5 / 110)), 'o': 0, 'v': bpm * 0.5}, {'far': abs(log2(bpm / 110)), 'o': 1, 'v': bpm}, {'far': abs(log2(bpm * 2.0 / 110)), 'o': 2, 'v': bpm * 2.0}]) as t from tempo),
k as (select session_id, event_id, bpm, min(t) filter (t.v between 45 and 210) as t from c group by all)
select session_id, event_id, round(coalesce(t.v, greatest(45, least(210, bpm))), 6) as folded from k""")
def _(spark, d):
    return _rounded(_tempo(spark, d).select("session_id", "event_id", T.fold_to(F.col("bpm"), F.lit(110.0)).alias("folded")))


@query("tempo_features", """, s as (select *, abs(bpm - lag(bpm) over w) as step, row_number() over w - 1 as i, count(*) over (partition by session_id) as n, greatest(1, avg(bpm) over (partition by session_id)) as a from tempo window w as (partition by session_id order by time_s, event_id)),
h as (select *, cast(floor(least(11, (n // 2) * 2 - 1) / 2) as bigint) as h from s),
near as (select x.session_id, x.event_id, median(y.bpm) as base from h x join generate_series(-5, 5) as g(k) on abs(g.k) <= x.h and x.n >= 5 join s y on y.session_id = x.session_id and y.i = greatest(0, least(x.n - 1, x.i + g.k)) group by 1, 2)
select session_id, round(coalesce(median(step) / any_value(a), 0), 6) as step_median, round(coalesce(quantile_cont(step, 0.9) / any_value(a), 0), 6) as step_p90,
  round(coalesce(avg(case when step is null then null when step <= greatest(0.35, a * 0.004) then 1.0::double else 0.0::double end), 1), 6) as stable_ratio,
  round(coalesce(stddev_pop(bpm - base) / any_value(a), 0), 6) as high_frequency, round(coalesce(stddev_pop(base) / any_value(a), 0), 6) as low_frequency
from h left join near using (session_id, event_id) group by 1""")
def _(spark, d):
    return _rounded(T.score_features(_tempo(spark, d)))


@query("seconds_to_ticks", """, f as (select *, case when lag(time_s) over w is null then 0 else time_s end as a from tempo window w as (partition by session_id order by time_s, event_id)),
p as (select *, lead(a) over (partition by session_id order by a, event_id) as b from f),
q as (select session_id, event_id, a, b, bpm, coalesce(sum((b - a) * bpm * 480 / 60) over (partition by session_id order by a, event_id rows between unbounded preceding and 1 preceding), 0) as done from p)
select n.session_id, n.event_id, cast(round_even(done + greatest(0, n.end_s - a) * bpm * 480 / 60, 0) as bigint) as tick from notes n join q on q.session_id = n.session_id and (n.end_s > a or a = 0) and (b is null or n.end_s <= b)""")
def _(spark, d):
    times = _notes(spark, d).select("session_id", "event_id", F.col("end_s").alias("at_s"))
    return T.ticks(_tempo(spark, d), times).select("session_id", "event_id", "tick")


def _bridged(source: str, name: str, brief: str) -> str:
    """Over source (session_id, i, t, v): name with its brief inner runs bridged.  ``brief`` sees the
    run o, the run l before it and the run x after it (n values, from t0 to t1)."""
    return f""", {name}_r as (select session_id, i, t, v, 0 as run, [v] as own from {source} where i = 0 union all
  select o.session_id, o.i, o.t, o.v, case when same then f.run else f.run + 1 end, case when same then list_append(f.own, o.v) else [o.v] end
  from (select *, i - 1 as p from {source}) o join {name}_r f on f.session_id = o.session_id and f.i = o.p, lateral (select abs(o.v - list_aggregate(f.own, 'median')) <= greatest(2, 0.025 * list_aggregate(f.own, 'median')) as same)),
{name}_g as (select session_id, run, count(*) as n, median(v) as m, min(t) as t0, max(t) as t1 from {name}_r group by 1, 2),
{name}_b as (select session_id, run, m as left_m, null::double as val from {name}_g where run = 0 union all
  select o.session_id, o.run, case when fix then (f.left_m + x.m) / 2 else o.m end, case when fix then (f.left_m + x.m) / 2 end
  from (select *, run - 1 as p from {name}_g) o join {name}_b f on f.session_id = o.session_id and f.run = o.p join {name}_g l on l.session_id = o.session_id and l.run = o.run - 1
  left join {name}_g x on x.session_id = o.session_id and x.run = o.run + 1, lateral (select coalesce(x.m is not null and ({brief}) and abs(f.left_m - x.m) <= greatest(3, 0.015 * (f.left_m + x.m)), false) as fix)),
{name} as (select session_id, i, t, coalesce(val, v) as v from {name}_r join {name}_b using (session_id, run))"""


SMOOTH = """, o as (select session_id, event_id, time_s as t, bpm, row_number() over (partition by session_id order by time_s, event_id) - 1 as i, count(*) over (partition by session_id) as n from tempo),
fo as (select session_id, -1::bigint as i, median(bpm) as level, []::double[] as w, []::double[] as out from o where i < 3 group by 1 union all
  select session_id, i, case when near then 0.85 * level + 0.15 * seen when len(w2) >= 3 then list_aggregate(w2, 'median') else level end, case when near or len(w2) >= 3 then [] else w2 end,
    case when near then list_append(out, seen) when len(w2) >= 3 then list_concat(out[1:len(out) - 2], w2) else list_append(out, level) end
  from (select *, case when len(w) > 0 and abs(seen - list_aggregate(w, 'median')) <= greatest(3, 0.03 * list_aggregate(w, 'median')) then list_append(w, seen) else [seen] end as w2, abs(seen - level) <= greatest(4, 0.04 * level) as near from (
    select *, case when far <= case when m in (0.5, 2) then log2(1.12) else log2(1.04) end and bpm / m between 45 and 210 then bpm / m else bpm end as seen from (
      select f.session_id, x.i, f.level, f.w, f.out, x.bpm, q.m, q.far from fo f join o x on x.session_id = f.session_id and x.i = f.i + 1,
        lateral (select arg_min(m, [abs(log2(x.bpm / greatest(f.level, 1) / m)), k]) as m, min(abs(log2(x.bpm / greatest(f.level, 1) / m))) as far from (values (0.5::double, 0), (2 / 3::double, 1), (0.75::double, 2), (1::double, 3), (4 / 3::double, 4), (1.5::double, 5), (2::double, 6)) as mt(m, k)) q)))),
fl as (select session_id, 1::bigint as i, out from fo where i = (select max(i) from o z where z.session_id = fo.session_id) union all
  select session_id, i + 1, case when len(out) > i + 3 and list_max(near) - list_min(near) <= 1.5 and abs(out[i + 2] - list_aggregate(near, 'median')) <= 8 then list_concat(out[1:i + 1], [list_aggregate(near, 'median')], out[i + 3:]) else out end
  from (select *, [out[i], out[i + 1], out[i + 3], out[i + 4]] as near from fl where i + 1 < len(out) - 2)),
s0 as (select x.session_id, x.i, x.t, y.out[x.i + 1] as v from o x join (select session_id, max_by(out, i) as out from fl group by 1) y using (session_id))""" + _bridged("s0", "s1", "o.n <= 2 or o.t1 - o.t0 <= 2.1")
REPAIR = _bridged("s1", "s2", "o.t1 - o.t0 <= 3.5 and x.t0 - l.t1 <= 7.5") + _bridged("s2", "s3", "o.t1 - o.t0 <= 3.5 and x.t0 - l.t1 <= 7.5")
RECURSIVE = V.SQL.lstrip().replace("with ", "with recursive ", 1)


def _smoothed_sql(steps: str, last: str) -> str:
    return RECURSIVE + steps + f" select session_id, event_id, round(o.t, 6) as time_s, round({last}.v, 6) as bpm from o join {last} using (session_id, i)"


@query("tempo_smooth", _smoothed_sql(SMOOTH, "s1"))
def _(spark, d):
    return _rounded(T.smoothed(_tempo(spark, d)))


@query("tempo_repair", _smoothed_sql(SMOOTH + REPAIR, "s3"))
def _(spark, d):
    return _rounded(T.smoothed(_tempo(spark, d), repaired=True))


GROUPS = """, o as (select *, row_number() over (partition by session_id order by start_s, midi_note, event_id) as i from notes),
rg as (with recursive r as (select session_id, i, event_id, start_s as anchor from o where i = 1 union all
  select o.session_id, o.i, o.event_id, case when o.start_s - r.anchor > 0.035 then o.start_s else r.anchor end from r join o on o.session_id = r.session_id and o.i = r.i + 1) select * from r),
g as (select o.*, rg.anchor from o join rg using (session_id, event_id))"""


@query("onset_groups", GROUPS + " select session_id, event_id, round(anchor, 6) as anchor from g")
def _(spark, d):
    return _rounded(G.onset_groups(_notes(spark, d)).select("session_id", "event_id", "anchor"))


@query("onset_group_times", GROUPS + " select session_id, round(anchor, 6) as anchor, count(*) as size, round(median(start_s), 6) as onset_s, round(max(start_s) - min(start_s), 6) as spread_s from g group by session_id, g.anchor")
def _(spark, d):
    return _rounded(G.group_times(G.onset_groups(_notes(spark, d))))


@query("onset_density", GROUPS + " select session_id, count(distinct anchor) as onsets, round(count(distinct anchor) / greatest(max(end_s), 1e-9), 6) as onsets_per_s from g group by 1")
def _(spark, d):
    return _rounded(G.density(G.onset_groups(_notes(spark, d))))


@query("polyphony", GROUPS + """, k as (select session_id, anchor, count(distinct midi_note) as p, count(distinct midi_note % 12) as c, list_sort(list(end_s - start_s), 'DESC') as l from g group by 1, 2)
select session_id, coalesce(bool_or(p >= 2 and c >= 3 and l[2] >= 1), false) or sum(case when p >= 2 then 1 else 0 end) >= 4 as polyphonic from k group by 1""")
def _(spark, d):
    return G.polyphony(G.onset_groups(_notes(spark, d)))


CHORDS = GROUPS + """, gt as (select session_id, anchor, count(*) as size, median(start_s) as onset_s, max(start_s) - min(start_s) as spread from g group by 1, 2),
cm as (select session_id, count(*) filter (size >= 2) as n, 100 * avg(case when spread < 0.0015 then 1.0::double else 0.0::double end) filter (size >= 2) as e, 100.0::double * count(*) filter (size >= 2) / count(*) as p, median(spread) filter (size >= 2) as m from gt group by 1),
met as (select session_id, case when n >= 12 then e end as exact_ratio, case when n >= 12 then p end as polyphonic_ratio, case when n >= 12 then m end as median_spread_s from cm)"""


@query("chord_onset_metrics", CHORDS + " select session_id, round(exact_ratio, 6) as exact_ratio, round(polyphonic_ratio, 6) as polyphonic_ratio, round(median_spread_s, 6) as median_spread_s from met")
def _(spark, d):
    return _rounded(G.chord_onset_metrics(G.onset_groups(_notes(spark, d))))


@query("note_coverage", """, c as (select session_id, greatest(start_s, 10) as a, least(end_s, 40) as b from notes where end_s > 10 and start_s < 40),
m as (select *, max(b) over (partition by session_id order by a, b rows between unbounded preceding and 1 preceding) as reach from c)
select session_id, round(sum(greatest(0, b - greatest(a, coalesce(reach, a)))) / 30, 6) as coverage from m group by 1""")
def _(spark, d):
    return _rounded(I.coverage(_notes(spark, d), 10.0, 40.0))


@query("note_merge", """ select session_id, event_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s, 0 as fresh from notes where end_s <= 22
union all select session_id, event_id, round(start_s + 20, 6), round(end_s + 20, 6), 1 from notes where start_s < 12 and end_s + 20 > 22""")
def _(spark, d):
    n = _notes(spark, d).select("session_id", "event_id", "start_s", "end_s")
    return _rounded(I.merge_notes(n.withColumn("fresh", F.lit(0)), n.where("start_s < 12").withColumn("fresh", F.lit(1)), 20.0))


@query("visible_notes", " select session_id, event_id, round(start_s, 6) as start_s, round(least(end_s, 25), 6) as end_s from notes where start_s <= 25 and end_s > start_s")
def _(spark, d):
    return _rounded(I.visible(_notes(spark, d), 25.0).select("session_id", "event_id", "start_s", "end_s"))


@query("rebase", " select session_id, event_id, round(greatest(0, start_s - 10), 6) as start_s, round(end_s - 10, 6) as end_s from notes where end_s > 10")
def _(spark, d):
    return _rounded(I.rebase(_notes(spark, d), 10.0).select("session_id", "event_id", "start_s", "end_s"))


@query("notes_active_at", """ select b.session_id, b.time_s, count(n.event_id) as sounding, min(n.midi_note) as lowest, coalesce(array_to_string(list_sort(list(distinct n.midi_note % 12) filter (n.midi_note is not null)), ' '), '') as classes
from beats b left join notes n on n.session_id = b.session_id and n.start_s <= b.time_s and b.time_s < n.end_s group by 1, 2""")
def _(spark, d):
    return I.active_at(_notes(spark, d), _beats(spark, d))


ASOF = """, bs as (select session_id, round_even(time_s, 4) as t from beats group by 1, 2),
sp as (select * from (select session_id, t, lead(t) over w as nx, row_number() over w - 1 as beat, count(*) over (partition by session_id) as n from bs window w as (partition by session_id order by t)) where n >= 3 and nx - t between 0.2 and 2),
ab as (select gt.*, sp.beat, sp.nx - sp.t as period, (gt.onset_s - sp.t) / (sp.nx - sp.t) as phase, count(*) over (partition by gt.session_id) as matched from (select *, count(*) over (partition by session_id) as groups from gt) gt join sp on sp.session_id = gt.session_id and gt.onset_s >= sp.t and gt.onset_s < sp.nx)"""
ERRORS = ASOF + """, er as (select session_id, onset_s, (phase - list_min([{'f': abs(phase - 0), 'i': 0, 'v': 0.0::double}, {'f': abs(phase - 0.25), 'i': 1, 'v': 0.25::double}, {'f': abs(phase - 1.0::double / 3), 'i': 2, 'v': 1.0::double / 3}, {'f': abs(phase - 0.5), 'i': 3, 'v': 0.5::double}, {'f': abs(phase - 2.0::double / 3), 'i': 4, 'v': 2.0::double / 3}, {'f': abs(phase - 0.75), 'i': 5, 'v': 0.75::double}, {'f': abs(phase - 1), 'i': 6, 'v': 1.0::double}]).v) * period as error_s from ab where groups >= 8)"""
STATS = ERRORS + """, ce as (select *, error_s - (quantile_cont(error_s, 0.5) over (partition by session_id)) as e from (select *, count(*) over (partition by session_id) as n from er) where n >= 8),
cu as (select *, greatest(0.012, quantile_cont(abs(e), 0.9) over (partition by session_id)) as cut from ce),
tot as (select session_id, sqrt(avg(pow(least(abs(e), cut), 2))) as dev, median(abs(e)) as mad from cu group by 1),
lb as (select session_id, max(round_even(time_s, 4)) as last_s from beats group by 1),
wi as (select ce.session_id, k, e from ce join lb using (session_id), range(0, 40) as r(k) where k * 5.0 < greatest(0, last_s - 9.99) and onset_s >= k * 5.0 and onset_s < k * 5.0 + 10),
wm as (select session_id, k, median(e) as m from wi group by 1, 2 having count(*) >= 8),
wl as (select session_id, median(c) as local from (select session_id, k, median(abs(e - m)) as c from wi join wm using (session_id, k) group by 1, 2) group by 1),
stats as (select session_id, 100 * exp(-pow(dev / 0.040, 2)) as grid_accuracy, dev * 1000 as deviation_ms, coalesce(local, mad) * 1000 as local_error_ms from tot left join wl using (session_id))"""


@query("beat_asof", CHORDS + ASOF + " select session_id, round(onset_s, 6) as onset_s, beat, round(phase, 6) as phase from ab")
def _(spark, d):
    times = G.group_times(G.onset_groups(_notes(spark, d))).select("session_id", "onset_s")
    return _rounded(X.asof_beat(times, X.beat_spans(_beats(spark, d))).select("session_id", "onset_s", F.col("beat").cast("long").alias("beat"), "phase"))


@query("grid_errors", CHORDS + ERRORS + " select session_id, round(onset_s, 6) as onset_s, round(error_s, 6) as error_s from er")
def _(spark, d):
    return _rounded(X.grid_errors(_notes(spark, d), _beats(spark, d)))


@query("grid_stats", CHORDS + STATS + " select session_id, round(grid_accuracy, 6) as grid_accuracy, round(deviation_ms, 6) as deviation_ms, round(local_error_ms, 6) as local_error_ms from stats")
def _(spark, d):
    return _rounded(X.grid_statistics(X.grid_errors(_notes(spark, d), _beats(spark, d)), _beats(spark, d)))


@query("logistic_evidence", CHORDS + STATS + """ select session_id, round(100 / (1 + exp(-greatest(-60, least(60, (grid_accuracy - 90) / 1.5)))), 6) as grid_mechanical, round(100 / (1 + exp(-greatest(-60, least(60, (5.75 - local_error_ms) / 0.75)))), 6) as local_mechanical from stats""")
def _(spark, d):
    return _rounded(X.mechanical_evidence(X.grid_statistics(X.grid_errors(_notes(spark, d), _beats(spark, d)), _beats(spark, d))).select("session_id", "grid_mechanical", "local_mechanical"))


ARTICULATION = """, ar as (select session_id, anchor, period, spread / period as s from ab where size >= 2),
spr as (select session_id, quantile_cont(s, 0.9) as spread_p90 from ar group by 1 having count(*) >= 8),
pr as (select l.session_id, l.midi_note as lo, r.midi_note as hi, (r.start_s - l.start_s) / ar.period as o from g l join g r on r.session_id = l.session_id and r.anchor = l.anchor and (l.midi_note, l.start_s, l.event_id) < (r.midi_note, r.start_s, r.event_id) join ar on ar.session_id = l.session_id and ar.anchor = l.anchor),
pm as (select session_id, lo, hi, median(o) as m from pr group by all having count(*) >= 4),
pa as (select session_id, case when count(*) >= 12 then median(abs(o - m)) end as pair_mad from pr join pm using (session_id, lo, hi) group by 1)"""


@query("articulation", CHORDS + ASOF + ARTICULATION + " select session_id, round(spread_p90, 6) as spread_p90, round(pair_mad, 6) as pair_mad from spr left join pa using (session_id)")
def _(spark, d):
    return _rounded(X.articulation(_notes(spark, d), _beats(spark, d)))


LOGISTIC = " + ".join(f"{w!r} * ({v} - {m!r}) / {k!r}" for v, w, m, k in zip(
    ("step_median", "step_p90", "stable_ratio", "high_frequency", "low_frequency", "grid_accuracy / 100", "deviation_ms * a / 60000", "exact_ratio / 100", "polyphonic_ratio / 100", "median_spread_s * a / 60", f"coalesce(spread_p90, {X.MEAN[10]!r})", f"coalesce(pair_mad, {X.MEAN[11]!r})"),
    X.WEIGHT, X.MEAN, X.SCALE, strict=True))
HUMAN = f""", lg as (select session_id, count(*) as points, corr(before, bpm) as lag1 from (select *, lag(bpm) over (partition by session_id order by time_s, event_id) as before from tempo) group by 1),
js as (select *, greatest(average_bpm, 1) as a from {_inside("tempo_summary")} join lg using (session_id) join {_inside("tempo_features")} using (session_id)
  left join {_inside("grid_stats")} using (session_id) left join {_inside("chord_onset_metrics")} using (session_id) left join {_inside("articulation")} using (session_id)),
je as (select *, case when points > 3 and bpm_std > 1e-9 then coalesce(abs(case when isnan(lag1) then 0 else lag1 end), 0) else 0 end as pattern, 100 / (1 + exp(-(grid_accuracy - 90) / 1.5)) as gm, 100 / (1 + exp(-greatest(-60, least(60, (5.75 - local_error_ms) / 0.75)))) as lm,
  100 / (1 + exp(-greatest(-30, least(30, {X.INTERCEPT!r} + {LOGISTIC})))) as calibrated,
  least(100 / (1 + exp(-greatest(-60, least(60, (step_p90 - 0.030) / 0.0075)))), 100 / (1 + exp(-greatest(-60, least(60, (1 - grid_accuracy / 100 - 0.150) / 0.025))))) as joint from js),
jt as (select *, greatest(0, least(100, 100 * (bpm_std / a / 0.045) * (0.65 + 0.35 * pattern))) as tempo_human from je),
jh as (select *, greatest(0, least(100, case when grid_accuracy is null then tempo_human when exact_ratio is not null then greatest(calibrated, joint) else 100 - least(greatest(gm, coalesce(lm, gm)), 100 - tempo_human) end)) as human from jt)"""


@query("human_score", HUMAN + " select session_id, round(bpm_std, 6) as bpm_std, round(coalesce(grid_accuracy, 0), 6) as grid_accuracy, round(coalesce(deviation_ms, 0), 6) as deviation_ms, round(human, 6) as human_score, round(100 - human, 6) as mechanical_index from jh")
def _(spark, d):
    return _rounded(X.human_score(_notes(spark, d), _tempo(spark, d), _beats(spark, d)))


CHROMA = """, fr as (select session_id, greatest(1, cast(ceil(max(end_s) * 8) as int)) as frames from notes group by 1),
na as (select *, greatest(0, cast(floor(start_s * 8) as int)) as a from notes join fr using (session_id)),
nb as (select *, least(frames, greatest(a + 1, cast(ceil(end_s * 8) as int))) as b from na),
cx as (select session_id, frame, pc, sum(w) as w from (select session_id, unnest(range(a, b)) as frame, midi_note % 12 as pc, 0.35 + 0.65 * confidence as w from nb) group by 1, 2, 3),
ch as (select session_id, cast(frame as int) as frame, pc as pitch_class, w / sum(w) over (partition by session_id, frame) as weight from cx)"""


@query("chroma", CHROMA + " select session_id, frame, pitch_class, round(weight, 6) as weight from ch")
def _(spark, d):
    return _rounded(H.chroma(_notes(spark, d)))


def _vectors(spark, d):
    e = V.read(spark, d, "embeddings")
    return e.select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double"))).alias("chroma"))


def _profile_rows() -> str:
    rows = [f"({r}, {str(major).lower()}, {[p[(i - r) % 12] for i in range(12)]}::double[])" for r in range(12) for p, major in ((H.MAJOR, True), (H.MINOR, False))]
    return ", ".join(rows)


def _scored_keys(ids: str) -> str:
    """Over v (ids, c): ky with the best key's root and major, and the two best scores."""
    return f""", z as (select {ids}, c, list_sum(c) / 12 as m, sqrt(list_sum(list_transform(c, lambda x: (x - list_sum(c) / 12) * (x - list_sum(c) / 12))) / 12) as s from v),
p(root, major, w) as (values {_profile_rows()}),
sc as (select {ids}, c, root, major, list_sum(list_transform(range(1, 13), lambda i: (c[i] - m) / (s + 1e-9) * w[i])) as score from z, p),
rk as (select *, row_number() over (partition by {ids} order by score desc, root desc, major desc) as r from sc),
ky as (select {ids}, any_value(c) as c, max(root) filter (r = 1) as root, bool_or(major) filter (r = 1) as major, max(score) filter (r = 1) as s1, max(score) filter (r = 2) as s2 from rk where r <= 2 group by {ids})"""


KEYS = " with v as (select vec_id, list_transform(embedding[1:12], lambda x: abs(x::double)) as c from embeddings)" + _scored_keys("vec_id")


@query("key_detect", KEYS + " select vec_id, root, major as is_major, round(greatest(0, least(1, (s1 - s2) / (abs(s1) + 1e-9))), 6) as key_confidence from ky")
def _(spark, d):
    return _rounded(H.detect_key(_vectors(spark, d)).drop("chroma"))


def _template_rows() -> str:
    rows = []
    for root in range(12):
        for k, (suffix, intervals, tension) in enumerate(H.TEMPLATES):
            rows.append(f"({root}, {k}, '{H.NAMES[root] + suffix}', {[(root + i) % 12 for i in intervals]}, {tension}::double)")
    return ", ".join(rows)


def _scored_chords(ids: str) -> str:
    """Over ky (ids, c, root, major): w with the templates in order (rn) and whether the vector is silent."""
    return f""", t(r, tk, chord, tones, tension) as (values {_template_rows()}),
x as (select {ids}, t.r as chord_root, tk, t.chord, list_sum(list_transform(tones, lambda i: c[i + 1])) as inside, list_sum(c) as total, len(list_filter(tones, lambda i: c[i + 1] < 0.055)) as missing, len(tones) as n, tension,
  list_contains(case when major then [0, 2, 4, 5, 7, 9, 11] else [0, 2, 3, 5, 7, 8, 10] end, (t.r - root + 12) % 12) as diatonic, list_max(c) as top, len(list_filter(c, lambda q: q >= greatest(0.055, list_max(c) * 0.16))) as active from ky, t),
y as (select *, inside - 0.42 * (total - inside) - 0.075 * missing - 0.025 * greatest(0, n - 3) + case when diatonic then 0.09 else 0 end + tension as score, total < 1e-7 or top < 0.14 or active < 2 as silent from x),
w as (select *, row_number() over (partition by {ids} order by round(score, 9) desc, chord_root, tk) as rn from y),
ct as (select {ids}, case when silent then 'N' else chord end as chord, case when silent then 0 else chord_root end as chord_root, case when silent then 0 else greatest(0, least(1, (score + 0.2) / 1.2)) end as sure from w where rn = 1)"""


@query("chord_classify", KEYS + _scored_chords("vec_id") + " select vec_id, chord, chord_root, round(sure, 6) as chord_confidence from ct")
def _(spark, d):
    return _rounded(H.classify_chord(H.detect_key(_vectors(spark, d))).select("vec_id", "chord", "chord_root", "chord_confidence"))


NAMES_SQL = str(list(M.NAMES))

#: Key windows (of 96 frames, every 32), keys, and the fold over them, from the chroma rows ch.
KEY_SEGMENTS = f""", nf as (select session_id, max(frame) + 1 as n from ch group by 1),
wk as (select session_id, n, unnest(range(0, cast((n - 1) // 32 as int) + 1)) as k from nf),
wa as (select session_id, n, k, k * 32 as lo, least(n, k * 32 + 96) as hi from wk union all select session_id, n, -1, 0, n from nf),
v as (select session_id, k, n, list(v order by pc) as c from (select w.session_id, w.k, w.n, pc, coalesce(sum(weight), 0) / any_value(hi - lo) as v from wa w cross join range(12) as g(pc) left join ch c on c.session_id = w.session_id and c.pitch_class = pc and c.frame >= lo and c.frame < hi group by 1, 2, 3, 4) group by 1, 2, 3)
{_scored_keys("session_id, k, n")},
kn as (select session_id, k, n, case when list_sum(c) > 1e-8 then {NAMES_SQL}[root + 1] || case when major then ' major' else ' minor' end else 'Unknown' end as name, case when list_sum(c) > 1e-8 then greatest(0, least(1, (s1 - s2) / (abs(s1) + 1e-9))) else 0 end as c from ky),
ld as (select session_id, max_by(name, c - k * 1e-15) as name, max(c) as c from kn where k between 0 and 2 group by 1),
ov as (select o.session_id, o.n, o.c as oc, case when ld.c >= 0.04 and ld.name <> 'Unknown' then ld.name else o.name end as key from kn o join ld using (session_id) where k = -1),
kf as (select session_id, -1::bigint as k, n, oc, key, 0::double as b, 0::double as cs, 0 as cn, null::varchar as rn, 0::double as ra, 0::double as rs, 0 as rc, null::varchar as closed, null::double as cb, null::double as ce, null::double as cc from ov
  union all
  select session_id, k, n, oc, case when won then name else key end, case when won then na else b end, case when won then ns when own then cs + c else cs end, case when won then nc when own then cn + 1 else cn end,
    case when own or won then null else name end, na, case when own or won then 0 else ns end, case when own or won then 0 else nc end, case when won then key end, b, na, case when cn > 0 then cs / cn else oc end
  from (select *, not own and nc > 1 and ns / nc >= 0.06 as won from (
    select f.session_id, w.k::bigint as k, f.n, f.oc, f.key, f.b, f.cs, f.cn, w.c, w.name, w.name = 'Unknown' or w.c < 0.04 or w.name = f.key as own,
      case when f.rn = w.name then f.ra else w.k * 4::double end as na, case when f.rn = w.name then f.rs + w.c else w.c end as ns, case when f.rn = w.name then f.rc + 1 else 1 end as nc
    from kf f join kn w on w.session_id = f.session_id and w.k = f.k + 1))),
ks as (select session_id, cb as start_s, ce as end_s, closed as key, cc as confidence from kf where closed is not null and ce > cb
  union all select session_id, b, n / 8::double, key, case when cn > 0 then cs / cn else oc end from kf where k = (n - 1) // 32 and n / 8::double > b)"""

#: Chord windows (of 10 frames, every 5), their repair in two passes and their runs, from ch and ks.
CHORD_SEGMENTS = f""", cw as (select session_id, n, unnest(range(0, cast((n - 1) // 5 as int) + 1)) as k from nf),
cv as (select session_id, k, n, list(v order by pc) as c from (select w.session_id, w.k, w.n, pc, coalesce(sum(weight), 0) / any_value(least(10, w.n - w.k * 5)) as v from cw w cross join range(12) as g(pc) left join ch c on c.session_id = w.session_id and c.pitch_class = pc and c.frame >= w.k * 5 and c.frame < w.k * 5 + 10 group by 1, 2, 3, 4) group by 1, 2, 3),
ck as (select *, k * 5 / 8::double as a, least(n, k * 5 + 5) / 8::double as b from cv),
la as (select session_id, max_by(key, start_s) as final from ks group by 1),
cj as (select ck.*, coalesce(s.key, la.final, 'Unknown') as key from ck left join ks s on s.session_id = ck.session_id and s.start_s <= (a + b) / 2 and (a + b) / 2 < s.end_s left join la on la.session_id = ck.session_id),
ky2 as (select session_id, k, n, a, b, key, c, coalesce(list_position({NAMES_SQL}, split_part(key, ' ', 1)) - 1, 0) as root, key = 'Unknown' or suffix(key, ' major') as major from cj)
{_scored_chords("session_id, k").replace("from ky, t", "from ky2, t")},
cn as (select session_id, k, n, a, b, key, chord, sure, case when chord = 'N' then '' else coalesce(case when major then case (chord_root - root + 12) % 12 when 0 then 'I' when 2 then 'ii' when 4 then 'iii' when 5 then 'IV' when 7 then 'V' when 9 then 'vi' when 11 then 'vii°' end
  else case (chord_root - root + 12) % 12 when 0 then 'i' when 2 then 'ii°' when 3 then 'III' when 5 then 'iv' when 7 then 'V' when 8 then 'VI' when 10 then 'VII' end end, printf('%+d', (chord_root - root + 12) % 12)) || case when suffix(chord, '7') then '7' else '' end end as function from ct join ky2 using (session_id, k)),
n1 as (select *, lead(chord) over w as next, lead(sure) over w as ns from cn window w as (partition by session_id order by k)),
r1 as (select session_id, k, chord, function, sure from n1 where k = 0 union all
  select f.session_id, o.k, case when fix then f.chord else o.chord end, case when fix then f.function else o.function end, case when fix then (f.sure + ns) / 2 else o.sure end
  from (select *, k - 1 as pk from n1) o join r1 f on f.session_id = o.session_id and f.k = o.pk, lateral (select coalesce(f.chord = o.next and o.chord <> f.chord, false) as fix)),
n2 as (select *, lead(chord) over w as next, lead(sure) over w as ns from r1 window w as (partition by session_id order by k)),
r2 as (select session_id, k, chord, function, sure from n2 where k = 0 union all
  select f.session_id, o.k, case when fix then f.chord else o.chord end, case when fix then f.function else o.function end, case when fix then (f.sure + ns) / 2 else o.sure end
  from (select *, k - 1 as pk from n2) o join r2 f on f.session_id = o.session_id and f.k = o.pk, lateral (select coalesce(f.chord = o.next and o.chord <> f.chord, false) as fix)),
m0 as (select r2.*, a, b, key from r2 join cn using (session_id, k)),
mg as (select session_id, k, chord, key, function, sure, a, b, 0 as run from m0 where k = 0 union all
  select o.session_id, o.k, o.chord, o.key, o.function, case when same then (f.sure + o.sure) / 2 else o.sure end, case when same then f.a else o.a end, o.b, case when same then f.run else f.run + 1 end
  from (select *, k - 1 as pk from m0) o join mg f on f.session_id = o.session_id and f.k = o.pk, lateral (select f.chord = o.chord and f.key = o.key as same)),
cs as (select session_id, a as start_s, b as end_s, chord, key, function, sure as confidence from mg qualify row_number() over (partition by session_id, run order by k desc) = 1)"""


@query("key_segments", RECURSIVE + CHROMA + KEY_SEGMENTS + " select session_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s, key, round(confidence, 6) as confidence from ks")
def _(spark, d):
    return _rounded(H.key_segments(H.chroma(_notes(spark, d))))


@query("roman", """ select vec_id, case (root - key_root + 12) % 12 when 0 then 'I' when 2 then 'ii' when 4 then 'iii' when 5 then 'IV' when 7 then 'V' when 9 then 'vi' when 11 then 'vii°' else printf('%+d', (root - key_root + 12) % 12) end || case when label % 2 = 0 then '7' else '' end as function
from (select vec_id, label, cast(vec_id % 12 as int) as root, cast((vec_id // 12) % 12 as int) as key_root from embeddings)""")
def _(spark, d):
    e = V.read(spark, d, "embeddings")
    chord = F.when(F.col("label") % 2 == 0, "C7").otherwise("C")
    return e.select("vec_id", H.roman((F.col("vec_id") % 12).cast("int"), (F.floor(F.col("vec_id") / 12) % 12).cast("int"), F.lit(True), chord).alias("function"))


@query("rle_compress", """, r as (select user_id as session_id, event_id, event_type, case when event_type <> lag(event_type) over (partition by user_id order by event_id) then 1 else 0 end as c from events),
s as (select *, sum(c) over (partition by session_id order by event_id) as k from r)
select session_id, any_value(event_type) as event_type, min(event_id) as first, max(event_id) as last, count(*) as length from s group by session_id, k""")
def _(spark, d):
    e = V.read(spark, d).select(F.col("user_id").alias("session_id"), "event_id", "event_type")
    return H.compress(e, "event_type", "event_id")


@query("meter_vote", """, b as (select session_id, time_s, case when (cast(time_s * 2 as int) + session_id) % 4 = 0 then 1.0::double else 0.25::double end as st, row_number() over (partition by session_id order by time_s) - 1 as i from beats),
m(meter, phase) as (values (3,0),(3,1),(3,2),(4,0),(4,1),(4,2),(4,3),(6,0),(6,1),(6,2),(6,3),(6,4),(6,5)),
s as (select session_id, meter, phase, avg(st) filter (i % meter = phase) - avg(st) filter (i % meter <> phase) as score from b, m group by 1, 2, 3),
r as (select *, row_number() over (partition by session_id order by score desc, meter desc, phase desc) as k from s)
select session_id, meter, phase, round(score, 6) as score from r where k = 1""")
def _(spark, d):
    b = _beats(spark, d).withColumn("strength", F.when((F.col("time_s") * 2).cast("int") % 4 == F.pmod(-F.col("session_id"), F.lit(4)), 1.0).otherwise(0.25))
    return _rounded(B.meter_vote(b))


@query("retention", """, f as (select user_id as session_id, max(ts) as newest, count(*) as files from events group by 1), r as (select *, row_number() over (order by newest desc, session_id desc) as k from f)
select session_id, files, k > 10 as expired from r""")
def _(spark, d):
    from strophe.sources.archive import expired

    files = V.read(spark, d).select(F.col("user_id").alias("session_id"), F.col("ts").alias("modified"))
    return expired(files, keep=10).select("session_id", "files", "expired")


@query("onset_envelope", """, f as (select distinct session_id, cast(round_even(start_s * 22050 / 128, 0) as bigint) as frame from notes),
e as (select session_id, frame + t.o as frame, t.w as w from f, (values (-2, 0.18::double), (-1, 0.58::double), (0, 1.0::double), (1, 0.58::double), (2, 0.18::double)) as t(o, w) where frame + t.o >= 0)
select session_id, frame, round(sum(w), 6) as strength from e group by 1, 2""")
def _(spark, d):
    return _rounded(S.onset_envelope(_notes(spark, d)))


@query("block_rms", """ select vec_id, round(20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding) + 1e-12), 1e-6)), 6) as level_db,
  20 * log10(greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding) + 1e-12), 1e-6)) >= -18 as is_signal from embeddings""")
def _(spark, d):
    e = V.read(spark, d, "embeddings")
    return _rounded(S.block_level(e, "embedding", -18.0).select("vec_id", "level_db", "is_signal"))


@query("manifest_errors", CHORDS + ERRORS + """, m as (select *, abs(error_s - (quantile_cont(error_s, 0.5) over (partition by session_id))) * 1000 as a from er)
select session_id, round(median(a), 6) as error_median_ms, round(quantile_cont(a, 0.75), 6) as error_p75_ms, round(quantile_cont(a, 0.9), 6) as error_p90_ms, round(100 * avg(case when a <= 10 then 1.0::double else 0.0::double end), 6) as within_10ms_pct from m group by 1""")
def _(spark, d):
    return _rounded(E.error_summary(X.grid_errors(_notes(spark, d), _beats(spark, d))))


RHYTHM = "list_min([" + ", ".join(f"{{'f': abs(VALUE - {r!r}::double), 'i': {i}, 'v': {r!r}::double}}" for i, r in enumerate(E.RHYTHMS)) + "]).v"

PHASE = "list_min([" + ", ".join(f"{{'f': abs(phase - {p!r}::double), 'i': {i}, 'v': {p!r}::double}}" for i, p in enumerate(X.PHASES)) + "]).v"


@query("ev_duration", CHORDS + ASOF + f""", dn as (select n.session_id, n.midi_note, (n.end_s - n.start_s) / (sp.nx - sp.t) as length from notes n join sp on sp.session_id = n.session_id and n.start_s >= sp.t and n.start_s < sp.nx),
dr as (select *, {RHYTHM.replace('VALUE', 'length')} as rhythm from dn where length between 0.05 and 8.5),
dm as (select session_id, midi_note, rhythm, median(length) as m from dr group by all having count(*) >= 4),
dk as (select session_id, median(abs(length - m)) as mad, count(*) as kept from dr join dm using (session_id, midi_note, rhythm) group by 1),
dg as (select session_id, median(abs(length - rhythm)) as grid, count(*) as n from dr group by 1)
select session_id, round(grid, 6) as duration_grid_mad, round(coalesce(mad, 0), 6) as duration_repeat_mad, round(coalesce(kept, 0) / n, 6) as duration_repeat_coverage from dg left join dk using (session_id)""")
def _(spark, d):
    return _rounded(E.duration_features(_notes(spark, d), _beats(spark, d)))


REPEAT = f""", tp as (select session_id, anchor, max(midi_note) as top, list_sort(list(distinct midi_note % 12)) as classes from g group by 1, 2),
t0 as (select *, beat + phase as pos, {PHASE} as place from ab join tp using (session_id, anchor) where matched >= 12),
t1 as (select *, phase - place as err, lead(pos) over w - pos as raw, greatest(-24, least(24, lead(top) over w - top)) as p1 from t0 window w as (partition by session_id order by onset_s)),
t2 as (select *, case when raw between 0.08 and 8.5 then raw end as s1 from t1),
t3 as (select *, case when s1 is not null then {RHYTHM.replace('VALUE', 's1')} end as r1 from t2),
t4 as (select *, lead(s1) over w as s2, lead(s1, 2) over w as s3, lead(p1) over w as p2, lead(p1, 2) over w as p3, lead(r1) over w as r2, lead(r1, 2) over w as r3 from t3 window w as (partition by session_id order by onset_s)),
tm as (select session_id, p1, r1, median(s1) as m from t4 where s1 is not null group by all having count(*) >= 5),
tk as (select session_id, median(abs(s1 - m)) as mad, quantile_cont(abs(s1 - m), 0.75) as p75, count(*) as kept from t4 join tm using (session_id, p1, r1) where s1 is not null group by 1),
hm as (select session_id, p1, p2, p3, r1, r2, r3, median(s1) as a, median(s2) as b, median(s3) as c from t4 where s1 is not null and s2 is not null and s3 is not null group by all having count(*) >= 3),
hu as (select session_id, unnest([abs(s1 - a), abs(s2 - b), abs(s3 - c)]) as far from t4 join hm using (session_id, p1, p2, p3, r1, r2, r3) where s1 is not null and s2 is not null and s3 is not null),
hk as (select session_id, median(far) as mad, count(*) / 3 as kept from hu group by 1),
gm as (select session_id, classes, place, median(err) as m from t4 group by all having count(*) >= 4),
gk as (select session_id, median(abs(err - m)) as mad, count(*) as kept from t4 join gm using (session_id, classes, place) group by 1),
tn as (select session_id, count(*) as n from t4 group by 1)"""


@query("ev_repeat", CHORDS + ASOF + REPEAT + """ select session_id, round(coalesce(tk.mad, 0), 6) as transition_repeat_mad, round(coalesce(p75, 0), 6) as transition_repeat_p75, round(coalesce(tk.kept, 0) / (n - 1), 6) as transition_repeat_coverage,
  round(coalesce(hk.mad, 0), 6) as phrase_repeat_mad, round(coalesce(hk.kept, 0) / (n - 3), 6) as phrase_repeat_coverage, round(coalesce(gk.mad, 0), 6) as pitch_grid_repeat_mad, round(coalesce(gk.kept, 0) / n, 6) as pitch_grid_repeat_coverage
from tn left join tk using (session_id) left join hk using (session_id) left join gk using (session_id)""")
def _(spark, d):
    return _rounded(E.repetition(_notes(spark, d), _beats(spark, d)))


@query("ev_artic", CHORDS + ASOF + ARTICULATION + """, sq as (select *, lag(s) over (partition by session_id order by onset_s) as q, min(onset_s) over (partition by session_id) as t0, max(onset_s) over (partition by session_id) as t1 from (select session_id, anchor, onset_s, period, spread / period as s from ab where size >= 2)),
sa as (select session_id, quantile_cont(s, 0.9) as p90, case when count(*) >= 2 then quantile_cont(s, 0.75) - quantile_cont(s, 0.25) else 0 end as iqr,
  case when count(q) >= 4 and stddev_pop(s) filter (q is not null) >= 1e-9 and stddev_pop(q) >= 1e-9 then corr(q, s) else 0 end as lag1, count(*) as n from sq group by 1),
w0 as (select session_id, k, median(s) as m from sq, range(0, 20) as r(k) where t0 + k * 10 < greatest(t0, t1 - 19.99) and onset_s >= t0 + k * 10 and onset_s < t0 + k * 10 + 20 group by 1, 2 having count(*) >= 6),
w1 as (select session_id, case when count(*) >= 2 then quantile_cont(m, 0.75) - quantile_cont(m, 0.25) else 0 end as stage_iqr from w0 group by 1),
s0 as (select sq.session_id, sq.anchor, any_value(s) as s, list(midi_note order by midi_note, start_s, g.event_id) as shape, count(*) as m, max(start_s) - min(start_s) as reach from sq join g on g.session_id = sq.session_id and g.anchor = sq.anchor group by 1, 2),
s1 as (select session_id, shape, median(s) as m from s0 group by all having count(*) >= 4),
s2 as (select session_id, median(abs(s0.s - s1.m)) as mad, count(*) as kept from s0 join s1 using (session_id, shape) group by 1),
pt as (select session_id, count(*) as pairs from pr group by 1),
pk as (select session_id, median(abs(o - m)) as mad, count(*) as kept from pr join pm using (session_id, lo, hi) group by 1),
po as (select session_id, avg(top) as ord from (select session_id, lo, hi, greatest(avg(case when o < 0 then 1.0::double else 0 end), avg(case when o = 0 then 1.0::double else 0 end), avg(case when o > 0 then 1.0::double else 0 end)) as top from pr group by all having count(*) >= 4) group by 1),
r0 as (select sq.session_id, sq.anchor, start_s, cast(row_number() over (partition by sq.session_id, sq.anchor order by midi_note, start_s, g.event_id) as double) as i from sq join g on g.session_id = sq.session_id and g.anchor = sq.anchor),
r1 as (select session_id, median(c) as roll from (select session_id, anchor, case when count(*) >= 4 then abs(corr(i, start_s)) else 0 end as c from r0 group by 1, 2 having count(*) >= 3 and max(start_s) - min(start_s) > 1e-5) group by 1)
select session_id, round(p90, 6) as chord_spread_p90, round(iqr, 6) as chord_spread_iqr, round(coalesce(pk.mad, 0), 6) as chord_pair_repeat_mad, round(coalesce(ord, 0.5), 6) as chord_pair_order_consistency, round(coalesce(pk.kept, 0) / greatest(1, pairs), 6) as chord_pair_repeat_coverage,
  coalesce(pk.kept, 0)::double as chord_pair_evidence_count, round(coalesce(s2.mad, 0), 6) as chord_shape_repeat_mad, round(coalesce(s2.kept, 0) / n, 6) as chord_shape_repeat_coverage, round(lag1, 6) as chord_spread_lag1, round(coalesce(stage_iqr, 0), 6) as chord_spread_stage_iqr, round(coalesce(roll, 0), 6) as chord_roll_linearity
from sa left join w1 using (session_id) left join s2 using (session_id) left join pt using (session_id) left join pk using (session_id) left join po using (session_id) left join r1 using (session_id)""")
def _(spark, d):
    return _rounded(E.attack_features(_notes(spark, d), _beats(spark, d)))


@query("ev_grid_stages", CHORDS + ASOF + f""", r0 as (select session_id, onset_s, phase - {PHASE} as raw, min(onset_s) over (partition by session_id) as t0, max(onset_s) over (partition by session_id) as t1 from ab where matched >= 8),
e0 as (select *, raw - (quantile_cont(raw, 0.5) over (partition by session_id)) as e from r0),
wi as (select session_id, k, e from e0, range(0, 40) as r(k) where t0 + k * 5 < greatest(t0, t1 - 9.99) and onset_s >= t0 + k * 5 and onset_s < t0 + k * 5 + 10),
wm as (select session_id, k, median(e) as m from wi group by 1, 2 having count(*) >= 8),
wd as (select session_id, k, any_value(m) as m, median(abs(e - m)) as d from wi join wm using (session_id, k) group by 1, 2),
ws as (select session_id, case when count(*) >= 2 then stddev_pop(m) else 0 end as low, case when count(*) >= 2 then quantile_cont(m, 0.75) - quantile_cont(m, 0.25) else 0 end as a, case when count(*) >= 2 then quantile_cont(d, 0.75) - quantile_cont(d, 0.25) else 0 end as b from wd group by 1)
select session_id, round(coalesce(low, 0), 6) as grid_error_low_frequency, round(coalesce(a, 0), 6) as grid_stage_median_iqr, round(coalesce(b, 0), 6) as grid_stage_mad_iqr from (select distinct session_id from r0) left join ws using (session_id)""")
def _(spark, d):
    return _rounded(E.grid_stages(_notes(spark, d), _beats(spark, d)))


@query("ev_tempo", """, s as (select *, row_number() over w - 1 as i, count(*) over (partition by session_id) as n, greatest(1, avg(bpm) over (partition by session_id)) as a from tempo window w as (partition by session_id order by time_s, event_id)),
nb as (select x.session_id, x.i, median(y.bpm) filter (abs(g.k) <= 2 and abs(g.k) * 2 + 1 <= (x.n // 2) * 2 - 1) as short, median(y.bpm) as long
  from s x join generate_series(-10, 10) as g(k) on x.n >= 8 and abs(g.k) * 2 + 1 <= (x.n // 2) * 2 - 1 join s y on y.session_id = x.session_id and y.i = greatest(0, least(x.n - 1, x.i + g.k)) group by 1, 2),
t0 as (select s.*, short, long, (short - lag(short) over w) / a as move, coalesce(case when abs(long - lag(long) over w) > greatest(4, a * 0.04) then 1 end, 0) as cut from s join nb using (session_id, i) window w as (partition by session_id order by i)),
t1 as (select *, sum(cut) over (partition by session_id order by i) as segment from t0),
ba as (select session_id, any_value(a) as a, stddev_pop(short - long) / any_value(a) as motion, stddev_pop(bpm - short) / any_value(a) as noise from t1 group by 1),
mv as (select session_id, sign(move) = sign(lag(move) over (partition by session_id order by i)) as same from t1 where abs(move) >= 0.001),
ke as (select session_id, case when count(*) >= 3 then avg(case when same then 1.0::double when not same then 0.0::double end) end as keeps from mv group by 1),
mi as (select session_id, median(d) as micro from (select session_id, segment, stddev_pop(bpm) as d from t1 group by 1, 2 having count(*) >= 8) group by 1),
st as (select session_id, k, stddev_pop(bpm) / any_value(a) as d from t1 join range(0, 10000) as r(k) on k * 8 <= i and i < k * 8 + 15 and (k = 0 or k * 8 + 15 <= n) group by 1, 2),
wa as (select session_id, case when count(*) >= 2 then quantile_cont(d, 0.75) - quantile_cont(d, 0.25) else 0 end as wander from st group by 1)
select session_id, round(coalesce(motion, 0), 6) as tempo_smooth_motion, round(coalesce(noise, 0), 6) as tempo_noise, round(coalesce(motion / greatest(motion + noise, 1e-9), 0), 6) as tempo_motion_coherence,
  round(coalesce(keeps, 0.5), 6) as tempo_direction_persistence, round(coalesce(micro / a, 0), 6) as tempo_segment_microvariation, round(coalesce(wander, 0), 6) as tempo_stage_variation
from (select distinct session_id from tempo) left join ba using (session_id) left join ke using (session_id) left join mi using (session_id) left join wa using (session_id)""")
def _(spark, d):
    return _rounded(E.tempo_motion(_tempo(spark, d)))


def _features_sql() -> str:
    neutral = {c: v for c, v in E.NEUTRAL.items()}
    parts = " ".join(f"left join {_inside(n)} using (session_id)" for n in ("tempo_features", "ev_tempo", "ev_grid", "ev_grid_stages", "ev_repeat", "ev_artic", "ev_duration"))
    own = ", ".join(f"round(coalesce({c}, {v}), 6) as {c}" for c, v in neutral.items())
    return f" select session_id, round(coalesce(columns(* exclude (session_id, {', '.join(neutral)})), 0), 6), {own} from (select distinct user_id as session_id from events) {parts}"


@query("feature_row")
def _(spark, d):
    return _rounded(E.feature_row(_notes(spark, d), _tempo(spark, d), _beats(spark, d)))


@query("ev_grid", CHORDS + ASOF + f""", r0 as (select session_id, onset_s, phase - {PHASE} as raw from ab where matched >= 8),
e0 as (select *, raw - (quantile_cont(raw, 0.5) over (partition by session_id)) as e from r0),
l0 as (select *, e - case when count(e) over f >= 4 then quantile_cont(e, 0.5) over f else 0 end as l from e0 window f as (partition by session_id order by onset_s range between 5 preceding and 5 following)),
p0 as (select *, lag(l) over (partition by session_id order by onset_s) as p from l0)
select session_id, round(median(abs(l)), 6) as grid_error_mad_beats, round(quantile_cont(abs(l), 0.9), 6) as grid_error_p90_beats,
  round(case when count(p) >= 4 and stddev_pop(l) filter (p is not null) >= 1e-9 and stddev_pop(p) >= 1e-9 then corr(p, l) else 0 end, 6) as grid_error_lag1,
  round(coalesce(median(abs(l - p)), 0) / greatest(median(abs(l)), 1e-6), 6) as grid_error_allan_ratio from p0 group by 1""")
def _(spark, d):
    return _rounded(E.local_grid(_notes(spark, d), _beats(spark, d)))


@query("valid_window", """, du as (select session_id, max(end_s) as d from notes group by 1),
o1 as (select session_id, start_s, end_s, max(end_s) over (partition by session_id order by start_s, end_s rows between unbounded preceding and 1 preceding) as reach from notes),
o2 as (select *, sum(case when reach is null or start_s > reach then 1 else 0 end) over (partition by session_id order by start_s, end_s rows unbounded preceding) as island from o1),
iv as (select session_id, min(start_s) as lo, max(end_s) as hi from o2 group by session_id, island),
en as (select distinct session_id, d, greatest(5, least(d, unnest([d, 5, end_s, start_s + 5]))) as e from notes join du using (session_id) where d >= 5),
sh as (select session_id, e, sum(greatest(0, least(hi, e) - greatest(lo, e - 5))) / 5 as share from en join iv using (session_id) group by 1, 2),
fi as (select session_id, min(e) as e from sh where share >= 0.15 group by 1),
vf as (select f.session_id, min(start_s) as v from fi f join notes n on n.session_id = f.session_id and end_s > e - 5 and start_s < e group by 1)
select d.session_id, round(v, 6) as valid_from, round(coalesce((select share from sh join fi on fi.session_id = sh.session_id and fi.e = sh.e where sh.session_id = d.session_id), (select max(share) from sh where sh.session_id = d.session_id), 0), 6) as coverage from du d left join vf using (session_id)""")
def _(spark, d):
    return _rounded(K.valid_windows(_notes(spark, d)))


@query("chord_segments", RECURSIVE + CHROMA + KEY_SEGMENTS + CHORD_SEGMENTS + f""", po as (select * from {_inside("polyphony")})
select session_id, round(start_s, 6) as start_s, round(end_s, 6) as end_s, chord, key, function, round(confidence, 6) as confidence from (
  select cs.* from cs join po using (session_id) where polyphonic union all select session_id, start_s, end_s, 'N', key, '', confidence from ks join po using (session_id) where not polyphonic)""")
def _(spark, d):
    n = _notes(spark, d)
    c = H.chroma(n)
    return _rounded(H.chord_segments(c, H.key_segments(c), G.polyphony(G.onset_groups(n))))


@query("note_names", """ select session_id, event_id, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi_note % 12 + 1] || (midi_note // 12 - 1) as note_name, round(440 * pow(2.0, (midi_note - 69) / 12.0::double), 6) as frequency,
  printf('%02d:%02d', cast(floor(start_s) as int) // 60, cast(floor(start_s) as int) % 60) as clock, case when confidence * 100 >= 70 then 'Humanized timing' when confidence * 100 <= 45 then 'Mechanically stable' else 'Mixed timing evidence' end as label from notes""")
def _(spark, d):
    n = _notes(spark, d)
    return _rounded(n.select("session_id", "event_id", M.note_name(F.col("midi_note")).alias("note_name"), M.frequency(F.col("midi_note")).alias("frequency"), M.clock(F.col("start_s")).alias("clock"), M.character(F.col("confidence") * 100).alias("label")))


@query("roles_cadence", """ select vec_id, case when label in (0, 2, 5, 7) then 'TONIC' when label in (1, 3) then 'PREDOMINANT' when label in (4, 6) then 'DOMINANT' else 'CHROMATIC' end as role,
  case when label = 4 and vec_id % 2 = 0 then 'AUTHENTIC CADENCE' when label = 3 and vec_id % 2 = 0 then 'PLAGAL CADENCE' when label in (1, 3) and vec_id % 2 = 1 then 'PREDOMINANT TO DOMINANT' else '' end as cadence from embeddings""")
def _(spark, d):
    e = V.read(spark, d, "embeddings")
    f = F.element_at(F.array(*[F.lit(x) for x in ("I", "ii", "iii", "IV", "V7", "vi", "vii°", "i7", "+1", "")]), F.col("label") + 1)
    last = F.when(F.col("vec_id") % 2 == 0, "I").otherwise("V")
    return e.select("vec_id", H.role(f).alias("role"), M.cadence(F.array(F.lit("vi"), f, F.lit(""), last)).alias("cadence"))


@query("beat_strength", """, nr as (select b.session_id, b.time_s, count(*) as n, min(midi_note) as low, bool_or(abs(round_even(n.start_s * (22050 / 128.0::double), 0) - round_even(b.time_s * (22050 / 128.0::double), 0)) <= 2) as hit from beats b join notes n on n.session_id = b.session_id and abs(n.start_s - b.time_s) <= 0.11 group by 1, 2),
bf as (select b.session_id, b.time_s, list(distinct midi_note % 12) as c from beats b join notes n on n.session_id = b.session_id and n.start_s <= b.time_s - 0.06 and b.time_s - 0.06 < n.end_s group by 1, 2),
af as (select b.session_id, b.time_s, list(distinct midi_note % 12) as c from beats b join notes n on n.session_id = b.session_id and n.start_s <= b.time_s + 0.06 and b.time_s + 0.06 < n.end_s group by 1, 2),
al as (select b.session_id, b.time_s, coalesce(n, 0) as n, low, coalesce(hit, false) as hit, coalesce(bf.c, []) as b, coalesce(af.c, []) as a from beats b left join nr using (session_id, time_s) left join bf using (session_id, time_s) left join af using (session_id, time_s)),
un as (select *, len(list_distinct(list_concat(b, a))) as whole, len(list_filter(b, lambda x: list_contains(a, x))) as shared from al)
select session_id, time_s, round(case when hit then 0.2::double else 0 end + 0.25::double * least(1, n / 4) + 0.25::double * coalesce(greatest(0, least(1, (72 - low) / 36)), 0) + 0.3::double * case when whole > 0 then 1 - shared / whole else 0 end, 6) as strength from un""")
def _(spark, d):
    return _rounded(B.beat_strength(_beats(spark, d), _notes(spark, d)))


@query("segment_at", """, sg as (select session_id, event_id, start_s, lead(start_s) over (partition by session_id order by start_s) - 0.2 as end_s, midi_note from notes),
s1 as (select session_id, start_s, coalesce(end_s, start_s + 1) as end_s, cast(midi_note as varchar) as value from sg),
la as (select session_id, max_by(value, start_s) as final from s1 group by 1)
select b.session_id, b.time_s, coalesce(s.value, la.final, 'Unknown') as value from beats b left join s1 s on s.session_id = b.session_id and s.start_s <= b.time_s and b.time_s < s.end_s left join la on la.session_id = b.session_id""")
def _(spark, d):
    n = _notes(spark, d)
    end = F.coalesce(F.lead("start_s").over(Window.partitionBy("session_id").orderBy("start_s")) - 0.2, F.col("start_s") + 1)
    return I.segment_at(_beats(spark, d), n.select("session_id", "start_s", end.alias("end_s"), F.col("midi_note").cast("string").alias("value")), "value")


#: The notes seen by 30 s, and chroma rows from them.
EARLY = ", seen as (select session_id, event_id, start_s, least(end_s, 30) as end_s, midi_note, confidence from notes where start_s <= 30 and end_s > start_s)" + CHROMA.replace("from notes", "from seen")


def _merge_sql(steps: str, table: str, columns: str, fill: str) -> str:
    """Segments before 18 s as seen by 30 s, later ones as seen at the end.  ``fill`` are the columns of a gap's own
    segment; without it a gap extends what precedes it."""
    early, late = (f"({RECURSIVE}{rows}{steps} select * from {table})" for rows in (EARLY, CHROMA))
    same = " and ".join(f"f.{c} = o.{c}" for c in columns.split(", ") if c != "function")
    gaps = f"union all select session_id, coalesce(r, 0), a, {fill}, 0::double as c, i - 0.5 from (select *, max(b) over (partition by session_id order by i rows between unbounded preceding and 1 preceding) as r, coalesce(lag(key) over (partition by session_id order by i), key) as last_key from cc) where a > coalesce(r, 0)" if fill else ""
    begin = "greatest(o.a, f.b)" if fill else "greatest(o.a, case when o.a > f.b then o.a else f.b end)"
    end = "f.b" if fill else "greatest(f.b, o.a)"
    own = lambda t: ", ".join(f"{t}.{c}" for c in columns.split(", "))
    return f"""with recursive early as {early}, late as {late},
du as (select session_id, max(end_s) as d from (select session_id, end_s from early union all select session_id, end_s from late) group by 1),
cl as (select session_id, start_s as a, least(end_s, 18) as b, {columns}, confidence as c, 0 as late from early where start_s < least(end_s, 18) union all
  select session_id, greatest(start_s, 18), end_s, {columns}, confidence, 1 from late where end_s > greatest(start_s, 18)),
cc as (select session_id, greatest(0, a) as a, least(d, b) as b, {columns}, c, row_number() over (partition by session_id order by a, b, late)::double as i from cl join du using (session_id) where least(d, b) > greatest(0, a)),
gp as (select session_id, a, b, {columns}, c, i from cc {gaps}),
od as (select *, row_number() over (partition by session_id order by i) as k, count(*) over (partition by session_id) as n from gp),
mf as (select session_id, k, n, {"a" if fill else "0::double as a"}, b, {columns}, c, 0 as run from od where k = 1 union all
  select o.session_id, o.k, o.n, case when skip or same then f.a else sa end, case when skip then fb else o.b end, {", ".join(f"case when skip then f.{c} else o.{c} end" for c in columns.split(", "))},
    case when skip then f.c when same then (f.c * (fb - f.a) + o.c * (o.b - sa)) / greatest(fb - f.a + o.b - sa, 1e-9) else o.c end, case when skip or same then f.run else f.run + 1 end
  from od o join mf f on f.session_id = o.session_id and o.k = f.k + 1, lateral (select {begin} as sa, {end} as fb, o.b <= {begin} as skip, {same} as same)),
ou as (select session_id, run, max_by(a, k) as a, max_by(b, k) as b, max_by(c, k) as c, {", ".join(f"max_by({c}, k) as {c}" for c in columns.split(", "))}, lead(max_by(a, k)) over (partition by session_id order by run) as next from mf group by session_id, run)
select session_id, round(a, 6) as start_s, round({"b" if fill else "coalesce(next, d)"}, 6) as end_s, round(c, 6) as confidence, {columns} from ou join du using (session_id)"""


@query("key_merge", _merge_sql(KEY_SEGMENTS, "ks", "key", ""))
def _(spark, d):
    n = _notes(spark, d)
    return _rounded(I.merged_keys(H.key_segments(H.chroma(I.visible(n, 30.0))), H.key_segments(H.chroma(n)), 18.0))


@query("chord_merge", _merge_sql(KEY_SEGMENTS + CHORD_SEGMENTS, "cs", "chord, key, function", "'N' as chord, last_key as key, '' as function"))
def _(spark, d):
    n = _notes(spark, d)
    old, new = (H.chroma(x) for x in (I.visible(n, 30.0), n))
    one = lambda c: H.chord_segments(c, H.key_segments(c))
    return _rounded(I.merged_chords(one(old), one(new), 18.0))


@query("meter_hysteresis", """with recursive o as (select user_id as session_id, event_id as seq, [3, 4, 6, null][cast(event_id // 1500 as int) % 4 + 1] as m, row_number() over (partition by user_id order by event_id) as i from events),
f as (select distinct session_id, 0::bigint as i, null::bigint as seq, null::int as stable, null::int as rival, 0 as runs, null::int as meter, false as changed from o
  union all
  select session_id, i, seq, case when won then m else stable end, case when m is null then rival when same or won then null else m end, case when m is null then runs when same or won then 0 else more end,
    case when m is null then coalesce(stable, rival, 4) when same or won then m else coalesce(stable, m) end, won and stable is not null
  from (select *, m is not null and not same and more >= case when stable is null then 3 else 8 end as won from (
    select f.session_id, o.i, o.seq, o.m, f.stable, f.rival, f.runs, coalesce(o.m = f.stable, false) as same, case when coalesce(o.m = f.rival, false) then f.runs + 1 else 1 end as more from f join o on o.session_id = f.session_id and o.i = f.i + 1)))
select session_id, seq, meter, changed from f where i > 0""")
def _(spark, d):
    e = V.read(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.element_at(F.array(F.lit(3), F.lit(4), F.lit(6), F.lit(None).cast("int")), (F.floor(F.col("event_id") / 1_500) % 4 + 1).cast("int")).alias("meter"))
    return B.settled_meters(e)


@query("tempo_track")
def _(spark, d):
    return _rounded(Y.tempo_tracks(_notes(spark, d)))


@query("beat_track")
def _(spark, d):
    return _rounded(Y.beat_tracks(_notes(spark, d)))


@query("replay")
def _(spark, d):
    return _rounded(Y.replay(_notes(spark, d)))


@query("replay_score")
def _(spark, d):
    return _rounded(E.replayed_rows(_notes(spark, d)))


FLOW = """, ch as (select session_id, start_s, end_s, case when event_id % 5 = 0 then 'N' else ['C', 'F', 'G7', 'Am'][midi_note % 4 + 1] end as chord, 'C major' as key, ['I', 'IV', 'V7', 'vi'][midi_note % 4 + 1] as function from notes),
c1 as (select *, chord = lag(chord) over (partition by session_id order by start_s, end_s, chord) as again from ch where chord <> 'N' and end_s >= 0 and start_s <= 40.05),
c2 as (select *, row_number() over (partition by session_id order by start_s desc, end_s desc, chord desc) as r from c1 where again is not true),
c3 as (select *, case function when 'I' then 'TONIC' when 'vi' then 'TONIC' when 'IV' then 'PREDOMINANT' else 'DOMINANT' end as role from c2 where r <= 8),
c4 as (select *, role <> lag(role) over (partition by session_id order by r desc) as fresh from c3),
c5 as (select session_id, string_agg(function || ' ' || chord, ' > ' order by r desc) as flow, string_agg(role, ' > ' order by r desc) filter (fresh is not false) as roles, max(function) filter (r = 1) as f1, max(function) filter (r = 2) as f2 from c4 group by 1)"""


@query("harmony_flow", FLOW + """ select session_id, flow, roles, case when f1 = 'I' and f2 = 'V7' then 'AUTHENTIC CADENCE' when f1 = 'I' and f2 = 'IV' then 'PLAGAL CADENCE' when f1 = 'V7' and f2 = 'IV' then 'PREDOMINANT TO DOMINANT' else '' end as cadence from c5""")
def _(spark, d):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("midi_note") % 4 + 1)
    chord = F.when(F.col("event_id") % 5 == 0, "N").otherwise(pick("C", "F", "G7", "Am"))
    c = _notes(spark, d).select("session_id", "start_s", "end_s", chord.alias("chord"), F.lit("C major").alias("key"), pick("I", "IV", "V7", "vi").alias("function"))
    return H.flow(c, 40.0)


@query("view_pitch_range", """, g as (select session_id, count(*) as visible, min(midi_note) as a, max(midi_note) as b from notes where end_s >= 10 and start_s <= 40 group by 1)
select session_id, visible, cast(greatest(24, a - 3) // 12 * 12 as int) as lowest, cast(least(120, greatest(greatest(24, a - 3) // 12 * 12 + 24, (least(108, b + 4) + 11) // 12 * 12)) as int) as highest from g""")
def _(spark, d):
    return D.pitch_range(_notes(spark, d), 10.0, 40.0)


@query("view_tempo_range", """, g as (select session_id, min(bpm) - 4 as a, max(bpm) + 4 as b from tempo where time_s between 10 and 14 group by 1)
select session_id, round(case when b - a < 12 then (a + b) / 2 - 6 else a end, 6) as low_bpm, round(case when b - a < 12 then (a + b) / 2 + 6 else b end, 6) as high_bpm from g""")
def _(spark, d):
    return _rounded(D.tempo_range(_tempo(spark, d), 10.0, 14.0))


@query("level_runs", CHROMA + """, f as (select session_id, pitch_class as pitch, frame, 20 * log10(weight) as db from ch),
r as (select *, frame - row_number() over (partition by session_id, pitch order by frame) as run from f where db > -20),
g as (select session_id, pitch, min(frame) / 8 as start_s, (max(frame) + 1) / 8 as end_s, median(db) as db from r group by session_id, pitch, run)
select session_id, pitch, start_s, end_s, round(greatest(0.05, least(1, (db + 46) / 34)), 6) as confidence from g where end_s - start_s >= 0.25""")
def _(spark, d):
    f = H.chroma(_notes(spark, d)).select("session_id", F.col("pitch_class").alias("pitch"), "frame", (20 * F.log10("weight")).alias("level_db"))
    return _rounded(S.level_runs(f, 8.0, -20.0, 0.25))


@query("probable_runs", CHROMA + """, f as (select session_id, pitch_class as pitch, frame, weight, weight >= 0.3 as act from ch),
b as (select *, max(case when act then frame end) over (partition by session_id, pitch order by frame rows between unbounded preceding and 1 preceding) as before from f),
r as (select *, sum(case when act and (before is null or frame - before > 2) then 1 else 0 end) over (partition by session_id, pitch order by frame) as run from b),
s as (select *, max(case when act then frame end) over (partition by session_id, pitch, run) as stop from r where run > 0),
g as (select session_id, pitch, min(frame) as first, any_value(stop) + 1 as stop, max(weight) as top, sum(weight) as total from s where frame <= stop group by session_id, pitch, run)
select session_id, pitch, first, stop, round(total / (stop - first), 6) as confidence from g where stop - first > 4 and top >= 0.58""")
def _(spark, d):
    f = H.chroma(_notes(spark, d)).select("session_id", F.col("pitch_class").alias("pitch"), "frame", F.col("weight").alias("probability"))
    return _rounded(S.probable_runs(f, tolerance=2, least=4))


@query("synthetic_feed", """ with t as (select i // 500 as block, i / 2000::double as t from range(32000) as g(i)),
s as (select block, t, 0.72 * exp(-55 * ((t * (108 + 3.8 * sin(2 * pi() * t / 18)) / 60) % 1)) * sin(2 * pi() * 1100 * t) as click, [261.63, 349.23, 392.00, 261.63][cast(floor(t / 4) as int) % 4 + 1]::double as root from t),
x as (select block, t, click + 0.12 * (sin(2 * pi() * root * t) + sin(2 * pi() * 1.25 * root * t) + sin(2 * pi() * 1.5 * root * t)) as v from s)
select block, min(t) as at_s, round(sqrt(avg(v * v)), 6) as rms, round(max(abs(v)), 6) as peak from x group by 1""")
def _(spark, d):
    x = synthetic.samples(spark, 16.0, rate=2000)
    return _rounded(x.groupBy("block").agg(F.min("at_s").alias("at_s"), F.sqrt(F.avg(F.col("sample") * F.col("sample"))).alias("rms"), F.max(F.abs("sample")).alias("peak")))


@query("spectrogram")
def _(spark, d):
    return _rounded(S.spectrograms(synthetic.blocks(synthetic.samples(spark, 4.0)), "block"))


@query("settings", """ select event_id, 22050 as sample_rate, coalesce(try_cast(json_extract_string(props, '$.k') as double), -48) as signal_threshold_db, 'auto' as recording_mode from events""")
def _(spark, d):
    e = V.read(spark, d).select("event_id", Settings.parsed(F.replace(F.col("props"), F.lit('"k"'), F.lit('"signal_threshold_db"'))).alias("s"))
    return e.select("event_id", "s.sample_rate", "s.signal_threshold_db", "s.recording_mode")



VALID = """, du as (select session_id, max(end_s) as d from notes group by 1),
o1 as (select session_id, start_s, end_s, max(end_s) over (partition by session_id order by start_s, end_s rows between unbounded preceding and 1 preceding) as reach from notes),
o2 as (select *, sum(case when reach is null or start_s > reach then 1 else 0 end) over (partition by session_id order by start_s, end_s rows unbounded preceding) as island from o1),
iv as (select session_id, min(start_s) as lo, max(end_s) as hi from o2 group by session_id, island),
en as (select distinct session_id, d, least(d, 5) as z, greatest(least(d, 5), least(d, unnest([d, 5, end_s, start_s + least(d, 5)]))) as e from notes join du using (session_id) where d > 0),
sh as (select session_id, any_value(d) as d, e, sum(greatest(0, least(hi, e) - greatest(lo, e - z))) / any_value(z) as share from en join iv using (session_id) group by session_id, e),
fi as (select session_id, min(e) as e from sh where share >= 0.15 group by 1),
vf as (select f.session_id, any_value(e) as valid_at, min(start_s) as valid_from from fi f join du using (session_id) join notes n on n.session_id = f.session_id and end_s > e - least(d, 5) and start_s < e group by 1)"""


@query("finalise", VALID + """, x as (select session_id, d, valid_from, greatest(0, coalesce(valid_from, 0) - 0.2) as lead from du left join vf using (session_id))
select session_id, round(lead, 6) as lead_s, round(d - lead, 6) as duration_s, case when d < 20 or (valid_from is not null and d - lead < 20) then 'short' when valid_from is null then 'empty' else 'archived' end as fate from x""")
def _(spark, d):
    return _rounded(Z.closing(_notes(spark, d)))


#: Pauses need gaps: every note lasts an eighth here, and those that begin from 20 to 30 s go.
@query("auto_pause", VALID.replace(", du as (", ", gp as (select session_id, start_s, start_s + (end_s - start_s) / 8 as end_s from notes where start_s not between 20 and 30), du as (", 1).replace("from notes", "from gp").replace("join notes", "join gp").replace("from gp where start_s not", "from notes where start_s not", 1) + """,
tk as (select session_id, unnest(range(1, cast(floor(d / 1.5) as int) + 1)) * 1.5::double as t from du),
co as (select session_id, t, sum(greatest(0, least(hi, t) - greatest(lo, greatest(0, t - 5)))) / least(5, t) as c from tk join iv using (session_id) group by 1, 2),
lo as (select co.session_id, min(t) as pause_s from co join vf using (session_id) where t >= 5 and t >= valid_at and valid_at - 5 >= 0 and c < 0.1 group by 1)
select session_id, round(pause_s, 6) as pause_s from du left join lo using (session_id)""")
def _(spark, d):
    n = _notes(spark, d).where("start_s not between 20 and 30").withColumn("end_s", F.col("start_s") + (F.col("end_s") - F.col("start_s")) / 8)
    return _rounded(Z.auto_pause(n))


@query("top_candidates", CHROMA + """, r as (select session_id, frame, pitch_class as pitch, weight, row_number() over (partition by session_id, frame order by weight desc, pitch_class) as rank from ch) select session_id, frame, pitch, round(weight, 6) as weight, cast(rank as int) as rank from r where rank <= 2""")
def _(spark, d):
    f = H.chroma(_notes(spark, d)).withColumnRenamed("pitch_class", "pitch")
    return _rounded(G.strongest(f, "weight", 2).select("session_id", "frame", "pitch", "weight", "rank"))


@query("unique_starts", " select session_id, count(distinct round_even(start_s, 3)) as starts, count(distinct round_even(start_s, 3)) < 4 as sparse from notes group by 1")
def _(spark, d):
    return G.unique_starts(_notes(spark, d))


@query("chord_evidence", f""", m as (select * from {_inside("chord_onset_metrics")})
select session_id, round(case when exact_ratio is not null then greatest(100 / (1 + exp(-greatest(-60, least(60, (exact_ratio - 45) / 3)))), 100 / (1 + exp(-greatest(-60, least(60, (polyphonic_ratio - 46) / 3))))) end, 6) as chord_mechanical from m""")
def _(spark, d):
    m = G.chord_onset_metrics(G.onset_groups(_notes(spark, d)))
    return _rounded(m.select("session_id", X.chord_evidence(F.col("exact_ratio"), F.col("polyphonic_ratio")).alias("chord_mechanical")))


@query("joint_evidence", f""" select session_id, round(least(100 / (1 + exp(-greatest(-60, least(60, (step_p90 - 0.030) / 0.0075)))), 100 / (1 + exp(-greatest(-60, least(60, (1 - grid_accuracy / 100 - 0.150) / 0.025))))), 6) as joint
from {_inside("tempo_features")} join {_inside("grid_stats")} using (session_id)""")
def _(spark, d):
    n, b = _notes(spark, d), _beats(spark, d)
    s = T.score_features(_tempo(spark, d)).join(X.grid_statistics(X.grid_errors(n, b), b), "session_id")
    return _rounded(s.select("session_id", X.joint_evidence(F.col("step_p90"), F.col("grid_accuracy")).alias("joint")))


@query("label_bars", """, v as (select session_id, [3, 4, 6][cast(session_id as int) % 3 + 1] as meter, cast(session_id as int) % 2 as phase from (select distinct session_id from beats)),
i as (select session_id, time_s, row_number() over (partition by session_id order by time_s) - 1 as i from beats), p as (select session_id, time_s, meter, (i - phase + meter) % meter as p from i join v using (session_id))
select session_id, time_s, cast(p + 1 as int) as beat_in_bar, p = 0 as is_downbeat, max(p + 1) over (partition by session_id)::int as meter from p""")
def _(spark, d):
    b = _beats(spark, d)
    pick = F.element_at(F.array(F.lit(3), F.lit(4), F.lit(6)), (F.col("session_id") % 3 + 1).cast("int"))
    bars = B.label_bars(b, b.select("session_id").distinct().select("session_id", pick.alias("meter"), (F.col("session_id") % 2).cast("int").alias("phase")))
    return bars.join(B.detected_meters(bars).hint("merge"), "session_id").select("session_id", "time_s", "beat_in_bar", "is_downbeat", "meter")


@query("visible_chords", """, c as (select session_id, event_id, start_s, end_s from notes where end_s >= 10 and start_s <= 40), x as (select *, (greatest(start_s, 10) - 10) * (1000 / 30::double) as x0, (least(end_s, 40) - 10) * (1000 / 30::double) as x1 from c)
select session_id, event_id, round(x0, 6) as x0, round(x1, 6) as x1, start_s <= 20 and 20 < end_s as active from x where x1 - x0 >= 2""")
def _(spark, d):
    return _rounded(D.visible_chords(_notes(spark, d), 10.0, 40.0, 20.0).select("session_id", "event_id", "x0", "x1", "active"))


@query("viewport", """ select event_id, round(greatest(s, start_s + 1) - s, 6) as from_s, round(greatest(s, start_s + 1), 6) as to_s, case when s <= 15 then 1 when s <= 90 then 5 when s <= 240 then 15 else 30 end as tick_s,
  round(greatest(6, least(600, s * case when event_id % 2 = 0 then 0.82 else 1.22 end)), 6) as zoomed_s from (select event_id, start_s, midi_note * 3.0::double as s from notes)""")
def _(spark, d):
    n = _notes(spark, d).withColumn("span", F.col("midi_note") * F.lit(3.0))
    return _rounded(n.select("event_id", D.viewport(F.col("start_s"), F.col("span")).alias("v"), D.zoomed(F.col("span"), F.col("event_id") % 2 == 0).alias("zoomed_s")).select("event_id", "v.*", "zoomed_s"))


@query("tempo_levels", RECURSIVE + """, o as (select session_id, bpm, avg(bpm) over (partition by session_id) as a, row_number() over (partition by session_id order by bpm) as i from tempo),
c as (select session_id, i, bpm, bpm as total, 1 as n, 0 as run from o where i = 1 union all
  select o.session_id, o.i, o.bpm, case when same then f.total + o.bpm else o.bpm end, case when same then f.n + 1 else 1 end, case when same then f.run else f.run + 1 end
  from o join c f on f.session_id = o.session_id and o.i = f.i + 1, lateral (select abs(o.bpm - f.total / f.n) <= greatest(2, 0.025 * o.a) as same)),
g as (select session_id, run, median(bpm) as m from c group by 1, 2 having count(*) > 1),
l as (select session_id, count(*) as k, min(m) as low, max(m) as high from g group by 1)
select session_id, case when k = 2 then 2 else 0 end as levels, case when k = 2 then round(low, 6) end as low, case when k = 2 then round(high, 6) end as high from (select distinct session_id from o) left join l using (session_id)""")
def _(spark, d):
    """The two repeated levels of each session's tempo around its mean."""

    def run(pdf):
        levels = T.repeated_levels(pdf["bpm"].tolist(), float(pdf["bpm"].mean()))
        return pdf[:1].assign(levels=len(levels), low=levels[0] if levels else None, high=levels[-1] if levels else None)[["session_id", "levels", "low", "high"]]

    return _rounded(_tempo(spark, d).groupBy("session_id").applyInPandas(run, "session_id long, levels int, low double, high double"))


@query("chord_sheets", """ select session_id, length(string_agg(printf('%.3f,%.3f,%s,%s', start_s, end_s, chord, 'C major'), chr(13) || chr(10) order by start_s, end_s) || chr(13) || chr(10)) + 1 + length('start_time,end_time,chord_name,key') + 2 as size, count(*) as lines
from (select session_id, start_s, end_s, 'C' || midi_note % 7 as chord from notes) group by 1""")
def _(spark, d):
    n = _notes(spark, d)
    c = export.sheets(n.select("session_id", "start_s", "end_s", F.concat(F.lit("C"), (F.col("midi_note") % 7).cast("string")).alias("chord"), F.lit("C major").alias("key")))
    return c.select("session_id", F.length("csv").cast("long").alias("size"), (F.size(F.split("csv", "\r\n")) - 2).cast("long").alias("lines"))


@query("midi_export", """ select session_id, count(*) as notes, 105::bigint as beats, (select count(*) from tempo t where t.session_id = n.session_id) + case when (select min(time_s) from tempo t where t.session_id = n.session_id) > 0 then 1 else 0 end as tempos from notes n group by 1""")
def _(spark, d):
    """Files of all sessions, written and parsed again."""
    beats = _beats(spark, d).withColumn("beat_in_bar", (F.col("time_s") * 2 % 4 + 1).cast("int")).withColumn("is_downbeat", F.col("beat_in_bar") == 1)
    made = midi.files(export.midi_events(_notes(spark, d).withColumn("velocity", F.lit(96)), _tempo(spark, d), beats))
    found = midi.parsed(made.select(F.col("session_id").cast("string").alias("path"), F.col("midi").alias("content")))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return found.groupBy(F.col("path").cast("long").alias("session_id")).agg(n("on").alias("notes"), n("marker").alias("beats"), n("tempo").alias("tempos"))


@query("chord_sheet_lines", """ select session_id, row_number() over (partition by session_id order by start_s, end_s, line) as i, line
from (select session_id, start_s, end_s, printf('%.3f,%.3f,C%d,C major', start_s, end_s, midi_note % 7) as line from notes)""")
def _(spark, d):
    n = _notes(spark, d)
    c = export.sheets(n.select("session_id", "start_s", "end_s", F.concat(F.lit("C"), (F.col("midi_note") % 7).cast("string")).alias("chord"), F.lit("C major").alias("key")))
    lines = c.select("session_id", F.posexplode(F.split("csv", "\r\n")).alias("i", "line"))
    return lines.where("i > 0 and line <> ''").select("session_id", F.col("i").cast("long").alias("i"), "line")


@query("midi_messages", """, f as (select *, case when lag(time_s) over w is null then 0 else time_s end as a from tempo window w as (partition by session_id order by time_s, event_id)),
p as (select *, lead(a) over (partition by session_id order by a, event_id) as b from f),
q as (select session_id, event_id, a, b, bpm, coalesce(sum((b - a) * bpm * 480 / 60) over (partition by session_id order by a, event_id rows between unbounded preceding and 1 preceding), 0) as done from p),
e as (select session_id, event_id, midi_note, 'on' as kind, start_s as at from notes union all select session_id, event_id, midi_note, 'off', end_s from notes),
t as (select e.*, cast(round_even(done + greatest(0, e.at - a) * bpm * 480 / 60, 0) as bigint) as tick from e join q on q.session_id = e.session_id and (e.at > a or a = 0) and (b is null or e.at <= b)),
o as (select n.session_id, n.midi_note, n.tick as first, greatest(m.tick, n.tick + 1) as last from t n join t m using (session_id, event_id) where n.kind = 'on' and m.kind = 'off')
select session_id, tick, kind, midi_note as pitch, count(*) as n from (
  select session_id, midi_note, 'on' as kind, first as tick from o union all select session_id, midi_note, 'off', last from o) group by all""")
def _(spark, d):
    """Every note message of the files that are written, with its tick."""
    beats = _beats(spark, d).withColumn("beat_in_bar", (F.col("time_s") * 2 % 4 + 1).cast("int")).withColumn("is_downbeat", F.col("beat_in_bar") == 1)
    made = midi.files(export.midi_events(_notes(spark, d).withColumn("velocity", F.lit(96)), _tempo(spark, d), beats))
    found = midi.parsed(made.select(F.col("session_id").cast("string").alias("path"), F.col("midi").alias("content"))).where("kind in ('on', 'off')")
    return found.groupBy(F.col("path").cast("long").alias("session_id"), "tick", "kind", "pitch").agg(F.count("*").alias("n"))


@query("replay_segments")
def _(spark, d):
    """Keys and chords as live refreshes leave them."""
    items = R.current(R.replayed(_notes(spark, d), timing=False))
    return _rounded(items.where("kind in ('key', 'chord')").select("session_id", "kind", "start_s", "end_s", "name", "key", "function", "confidence"))


@query("closed_sessions")
def _(spark, d):
    """What the archive gets of every session that is kept."""
    n = _notes(spark, d)
    return _rounded(L.finished(R.replayed(n, timing=False), n))


# a vector's three largest values are a chord, each in a range of its own
@query("transcribed_chords", """ with v as (select vec_id, list_transform(embedding[1:12], lambda x: abs(x::double)) as c from embeddings where len(embedding) >= 12),
p as (select vec_id, unnest(range(12)) as pitch_class, unnest(c) as x from v),
r as (select vec_id, pitch_class, row_number() over (partition by vec_id order by x desc, pitch_class) as k from p)
select cast(30 + 14 * k + pitch_class as int) as midi_note, count(*) as notes, true as nearly_all from r where k <= 3 group by 1""")
def _(spark, d):
    """Chords of all vectors, rendered as audio and transcribed: whether nine
    of ten notes of each pitch come back within 50 ms."""
    v = V.read(spark, d, "embeddings").where(F.size("embedding") >= 12)
    top = F.slice(F.array_sort(F.transform(F.slice("embedding", 1, 12), lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("x"), i.alias("pitch_class")))), 1, 3)
    notes = v.select(F.col("vec_id").alias("session_id"), F.posexplode(top).alias("k", "c")).select("session_id", F.lit(0.25).alias("start_s"), F.lit(0.9).alias("end_s"), (44 + 14 * F.col("k") + F.col("c.pitch_class")).cast("int").alias("midi_note"))
    heard = A.transcribe(A.rendered(notes, 1.0, block_s=1.0)).where("abs(start_s - 0.25) <= 0.05").select("session_id", "midi_note").distinct().withColumn("heard", F.lit(True))
    return notes.join(heard, ["session_id", "midi_note"], "left").groupBy("midi_note").agg(F.count("*").alias("notes"), (F.count("heard") >= 0.9 * F.count("*")).alias("nearly_all"))


SQL["feature_row"] = V.SQL + _features_sql()
