"""Beat-grid timing, articulation and the calibrated timing-character score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators import tempo as T
from strophe.operators.grouping import chord_onset_metrics, group_times, onset_groups

PHASES = (0.0, 0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0)

# Fixed values of the calibration, in the order of FEATURES.
FEATURES = ("step_median", "step_p90", "stable_ratio", "high_frequency", "low_frequency", "grid", "deviation_beats", "exact", "polyphonic", "spread_beats", "spread_p90", "pair_mad")
MEAN = (0.001124417195, 0.026243892384, 0.666373292202, 0.027356672420, 0.048568949813, 0.859703512692, 0.027069469526, 0.421627875881, 0.361139562842, 0.010914157254, 0.034926333143, 0.005259115162)
SCALE = (0.001401391782, 0.021202519274, 0.115107425000, 0.028075902756, 0.052735753382, 0.070157083258, 0.009142679096, 0.114028775816, 0.120220492900, 0.007379380831, 0.009957578815, 0.004526166205)
WEIGHT = (0.036096435331, 0.165445972255, -0.124490349412, 0.071181063725, 0.053515069574, -0.146747748585, 0.071016048316, -0.214463460720, -0.262321132484, 0.207108990377, 0.288565295525, 0.310068392578)
INTERCEPT = 0.335035536850


def beat_spans(beats: DataFrame) -> DataFrame:
    """session_id, beat_s, next_s, beat: distinct beats at 4 digits with their
    successor; sessions of three beats or more."""
    b = beats.select("session_id", F.bround("time_s", 4).alias("beat_s")).distinct()
    w = Window.partitionBy("session_id").orderBy("beat_s")
    b = b.withColumn("next_s", F.lead("beat_s").over(w)).withColumn("beat", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    return b.where("n >= 3").drop("n")


def asof_beat(onsets: DataFrame, spans: DataFrame) -> DataFrame:
    """Onsets (session_id, onset_s, ...) with the beat they follow, its period
    (0.2 to 2 s) and their phase in it.

    Beats and onsets go through one window over their union, so no pair of
    them is made.
    """
    cols = [c for c in onsets.columns if c not in ("session_id", "onset_s")]
    types = dict(onsets.dtypes)
    b = spans.select("session_id", F.col("beat_s").alias("at"), F.lit(0).alias("kind"), F.struct("beat_s", "next_s", "beat").alias("b"), *[F.lit(None).cast(types[c]).alias(c) for c in cols])
    o = onsets.select("session_id", F.col("onset_s").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(b.schema["b"].dataType).alias("b"), *cols)
    w = Window.partitionBy("session_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    x = b.unionByName(o).withColumn("b", F.last("b", ignorenulls=True).over(w)).where("kind = 1")
    period = F.col("b.next_s") - F.col("b.beat_s")
    return x.where(period.between(0.2, 2.0)).select("session_id", F.col("at").alias("onset_s"), *cols, F.col("b.beat").alias("beat"), period.alias("period_s"), ((F.col("at") - F.col("b.beat_s")) / period).alias("phase"))


def nearest(value: Column, grid) -> Column:
    """The nearest value of a fixed grid, the first of equals."""
    return F.array_min(F.array(*[F.struct(F.abs(value - g).alias("far"), F.lit(i).alias("i"), F.lit(float(g)).alias("value")) for i, g in enumerate(grid)]))["value"]


def timed_groups(groups: DataFrame, beats: DataFrame) -> DataFrame:
    """Onset groups (session_id, onset_s, anchor, size, spread_s) with n, the
    groups of their session, and the beat that they follow."""
    times = group_times(groups).withColumn("n", F.count("*").over(Window.partitionBy("session_id")))
    return asof_beat(times, beat_spans(beats))


def errors_of(timed: DataFrame) -> DataFrame:
    """``grid_errors`` of timed groups."""
    return timed.where("n >= 8").select("session_id", "onset_s", ((F.col("phase") - nearest(F.col("phase"), PHASES)) * F.col("period_s")).alias("error_s"))


def grid_errors(notes: DataFrame, beats: DataFrame) -> DataFrame:
    """session_id, onset_s, error_s: signed distance from the nearest phase;
    sessions of eight onset groups or more."""
    return errors_of(timed_groups(onset_groups(notes), beats))


def grid_statistics(errors: DataFrame, beats: DataFrame) -> DataFrame:
    """session_id, grid_accuracy, deviation_ms, local_error_ms; sessions of
    eight errors or more."""
    one = Window.partitionBy("session_id")
    e = errors.withColumn("n", F.count("*").over(one)).where("n >= 8").withColumn("e", F.col("error_s") - F.percentile("error_s", 0.5).over(one))
    cut = F.greatest(F.lit(0.012), F.percentile(F.abs("e"), 0.9).over(one))
    total = e.withColumn("cut", cut).groupBy("session_id").agg(F.sqrt(F.avg(F.pow(F.least(F.abs("e"), F.col("cut")), 2))).alias("dev"), F.median(F.abs("e")).alias("mad"))
    last = beats.groupBy("session_id").agg(F.max(F.bround("time_s", 4)).alias("last_s"))
    # windows of 10 s every 5 s that start before last - 9.99
    k = F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("onset_s") / 5).cast("int") - 1), F.floor(F.col("onset_s") / 5).cast("int")))
    x = e.where("onset_s >= 0").join(last, "session_id").withColumn("k", k).where("k * 5.0 < greatest(0.0, last_s - 9.99)")
    local = Window.partitionBy("session_id", "k")
    x = x.withColumn("m", F.count("*").over(local)).where("m >= 8").withColumn("c", F.abs(F.col("e") - F.percentile("e", 0.5).over(local)))
    local_mad = x.groupBy("session_id", "k").agg(F.median("c").alias("c")).groupBy("session_id").agg(F.median("c").alias("local"))
    return total.join(local_mad, "session_id", "left").select("session_id", (100.0 * F.exp(-F.pow(F.col("dev") / 0.040, 2))).alias("grid_accuracy"), (F.col("dev") * 1000.0).alias("deviation_ms"), (F.coalesce("local", "mad") * 1000.0).alias("local_error_ms"))


def _logistic(x: Column, bound: float = 60.0) -> Column:
    return 100.0 / (1.0 + F.exp(-F.greatest(F.lit(-bound), F.least(F.lit(bound), x))))


def mechanical_evidence(stats: DataFrame) -> DataFrame:
    """stats with grid_mechanical and local_mechanical (0 to 100)."""
    return stats.withColumn("grid_mechanical", _logistic((F.col("grid_accuracy") - 90.0) / 1.5)).withColumn("local_mechanical", _logistic((F.lit(5.75) - F.col("local_error_ms")) / 0.75))


def chord_evidence(exact_ratio: Column, polyphonic_ratio: Column) -> Column:
    """How mechanical the chord attacks are; null without them."""
    return F.when(exact_ratio.isNotNull(), F.greatest(_logistic((exact_ratio - 45.0) / 3.0), _logistic((polyphonic_ratio - 46.0) / 3.0)))


def joint_evidence(step_p90: Column, grid_accuracy: Column) -> Column:
    """High only where both the tempo moves and the grid is loose."""
    return F.least(_logistic((step_p90 - 0.030) / 0.0075), _logistic((1.0 - grid_accuracy / 100.0 - 0.150) / 0.025))


def articulation(notes: DataFrame, beats: DataFrame) -> DataFrame:
    """session_id, spread_p90, pair_mad: attack spreads in beats, and how
    repeatable the offsets of pitch pairs are; nulls without evidence."""
    groups = onset_groups(notes)
    return attacks_of(groups, timed_groups(groups, beats))


def attacks_of(groups: DataFrame, timed: DataFrame) -> DataFrame:
    """``articulation`` of onset groups and their times."""
    timed = timed.where("size >= 2").withColumn("spread", F.col("spread_s") / F.col("period_s"))
    spreads = timed.groupBy("session_id").agg(F.count("*").alias("n"), F.percentile("spread", 0.9).alias("spread_p90")).where("n >= 8").drop("n")
    # pairs inside of a group of notes struck together (at most 35 ms)
    own = groups.join(timed.select("session_id", "anchor", "period_s"), ["session_id", "anchor"]).groupBy("session_id", "anchor", "period_s").agg(F.array_sort(F.collect_list(F.struct("midi_note", "start_s", "event_id"))).alias("a"))
    pairs = own.select("session_id", "period_s", F.posexplode("a").alias("i", "l"), "a").select("session_id", "period_s", "l", F.explode(F.expr("slice(a, i + 2, size(a))")).alias("r"))
    offsets = pairs.select("session_id", F.col("l.midi_note").alias("low"), F.col("r.midi_note").alias("high"), ((F.col("r.start_s") - F.col("l.start_s")) / F.col("period_s")).alias("offset"))
    pair = Window.partitionBy("session_id", "low", "high")
    kept = offsets.withColumn("m", F.count("*").over(pair)).where("m >= 4").withColumn("far", F.abs(F.col("offset") - F.percentile("offset", 0.5).over(pair)))
    mads = kept.groupBy("session_id").agg(F.count("*").alias("n"), F.median("far").alias("mad")).select("session_id", F.when(F.col("n") >= 12, F.col("mad")).alias("pair_mad"))
    return spreads.join(mads, "session_id", "left")


def human_score(notes: DataFrame, tempo: DataFrame, beats: DataFrame) -> DataFrame:
    """session_id, bpm_std, grid_accuracy, deviation_ms, human_score,
    mechanical_index.

    Without a grid the tempo alone decides; without chord attacks the
    mechanical evidence does; else the calibrated logistic, with means for
    missing features, or the joint evidence if that is higher.
    """
    w = T.by_time()
    lagged = tempo.withColumn("before", F.lag("bpm").over(w)).groupBy("session_id").agg(F.count("*").alias("points"), F.corr("before", "bpm").alias("lag1"))
    s = T.summary(tempo).join(lagged, "session_id").join(T.score_features(tempo), "session_id")
    groups = onset_groups(notes)
    timed = timed_groups(groups, beats)
    s = s.join(mechanical_evidence(grid_statistics(errors_of(timed), beats)), "session_id", "left").join(chord_onset_metrics(groups), "session_id", "left").join(attacks_of(groups, timed), "session_id", "left")
    average = F.greatest("average_bpm", F.lit(1.0))
    pattern = F.when((F.col("points") > 3) & (F.col("bpm_std") > 1e-9), F.coalesce(F.abs(F.nanvl("lag1", F.lit(0.0))), F.lit(0.0))).otherwise(0.0)
    tempo_human = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.col("bpm_std") / average / 0.045) * (0.65 + 0.35 * pattern)))
    chords = F.col("exact_ratio").isNotNull()
    values = [F.col(c) for c in FEATURES[:5]] + [
        F.col("grid_accuracy") / 100.0,
        F.col("deviation_ms") * average / 60000.0,
        F.col("exact_ratio") / 100.0,
        F.col("polyphonic_ratio") / 100.0,
        F.col("median_spread_s") * average / 60.0,
        F.coalesce("spread_p90", F.lit(MEAN[10])),
        F.coalesce("pair_mad", F.lit(MEAN[11])),
    ]
    logit = F.lit(INTERCEPT)
    for v, m, k, c in zip(values, MEAN, SCALE, WEIGHT, strict=True):
        logit = logit + c * (v - m) / k
    calibrated = F.greatest(_logistic(logit, 30.0), joint_evidence(F.col("step_p90"), F.col("grid_accuracy")))
    mechanical = F.least(F.greatest("grid_mechanical", F.coalesce("local_mechanical", "grid_mechanical")), 100.0 - tempo_human)
    human = F.when(F.col("grid_accuracy").isNull(), tempo_human).when(chords, calibrated).otherwise(100.0 - mechanical)
    human = F.greatest(F.lit(0.0), F.least(F.lit(100.0), human))
    return s.select("session_id", "bpm_std", F.coalesce("grid_accuracy", F.lit(0.0)).alias("grid_accuracy"), F.coalesce("deviation_ms", F.lit(0.0)).alias("deviation_ms"), human.alias("human_score"), (100.0 - human).alias("mechanical_index"))
