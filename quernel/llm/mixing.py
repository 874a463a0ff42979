"""Problem 9: mixing sources to target weights as a time-varying curriculum.

Every source s has a weight schedule of its own, w_s(t) = share_s * (1 + a_s * (2 t - 1)) over training time t in [0, 1].
The slopes a_s are given by source; where none are, scarce sources, which must be repeated most, come late. They are centred
so that the weights add up to the listed shares at every t. Integrated, the schedule gives the
source's cumulative token demand D_s(t) = T * share_s * (t + a_s * (t^2 - t)). A record that covers the tokens
[c, c + n) of its source's stream is trained at the t with D_s(t) = c + n / 2, and records are range-sorted by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.tokens import DEFAULT_FILE, token_counts
from quernel.session import bounded_rows, spread, stage

MAX_SOURCES = 10_000
ROWS_PER_BUCKET = 20_000


def _plan(documents: DataFrame, targets: DataFrame, total, slope: float, path: str, schedules: dict[str, float] | None):
    spark = documents.sparkSession
    goal = {}
    for r in bounded_rows(targets.select("source", "target_share", "max_repeats").distinct(), MAX_SOURCES, "mix_targets"):
        if r.source is not None and (name := r.source.strip().lower()):
            if name in goal:
                raise ValueError(f"mix_targets names {name!r} twice")
            goal[name] = (float(r.target_share or 0), int(r.max_repeats or 0))
    source = F.lower(F.trim("source"))
    rows = documents.where(source.isin(list(goal)) & F.col("text").isNotNull() & (F.length("text") > 0))
    rows = rows.select("doc_id", source.alias("source"), F.xxhash64("text").alias("h"), F.xxhash64(F.lit(17), "text").alias("g"), "text")
    # copies of a row fall away by 128 bits of their text, so that no text is shuffled
    counted = token_counts(spread(rows, "doc_id"), ["doc_id", "source", "h", "g"], "text", path).where("n_tokens > 0")
    sized = stage(counted.dropDuplicates(["doc_id", "source", "h", "g"]).drop("h", "g"), "mix-sized")
    have = {r.source: (r.n, r.k) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("k")).collect()}
    able = [s for s, (share, times) in goal.items() if s in have and share > 0 and times > 0]
    if total is None:  # the most that keeps every present source at its share within its repeats
        total = min((have[s][0] * goal[s][1] / goal[s][0] for s in able), default=0.0)
    wanted = {k.strip().lower(): float(v) for k, v in (schedules or {}).items()}
    if schedules is None:
        scarce = sorted(able, key=lambda s: (goal[s][0] / have[s][0], s))
        wanted = {s: 2 * k / max(1, len(able) - 1) - 1 for k, s in enumerate(scarce)}
    weight = sum(goal[s][0] for s in able)
    mean = sum(wanted.get(s, 0.0) * goal[s][0] for s in able) / weight if weight else 0.0
    far = max((abs(wanted.get(s, 0.0) - mean) for s in able), default=0)
    # with schedules of the caller the slopes are as given, but for what keeps every weight above 0
    scale = slope / far if far and (schedules is None or far > 0.99) else 1.0 if schedules is not None else 0.0
    tilt = {s: scale * (wanted.get(s, 0.0) - mean) for s in able}
    plan = [(s, goal[s][0], tilt[s], min(total * goal[s][0], have[s][0] * goal[s][1]), have[s][0]) for s in able]
    buckets = max(1, -(-sum(k for _, k in have.values()) // ROWS_PER_BUCKET))
    return spark, goal, have, plan, sized, buckets


def _chosen(spark, plan, sized: DataFrame, buckets: int) -> DataFrame:
    schema = "source string, share double, tilt double, demand double, size bigint"
    plans = F.broadcast(spark.createDataFrame(plan, schema))  # at most MAX_SOURCES rows
    # Prefix sums in two levels, so that no source is summed in one task: over the buckets, then within each.
    order = F.xxhash64("doc_id")
    rows = sized.withColumn("bucket", F.pmod(order, F.lit(buckets))).withColumn("rank", order)
    sums = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    rows = rows.join(sums, ["source", "bucket"]).join(plans, "source")
    passes = F.ceil(F.col("demand") / F.col("size")).cast("int")
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.greatest(passes - 1, F.lit(0)))))
    middle = F.col("repeat") * F.col("size") + F.col("base") + F.col("inner") + F.col("n_tokens") / 2
    rows = rows.withColumn("middle", middle).where(F.col("middle") <= F.col("demand"))
    u, a = F.col("middle") / F.col("demand"), F.col("tilt")
    # a t^2 + (1 - a) t - u = 0, in the form that stays stable for small a
    t = 2 * u / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * u))
    return rows.select(
        "doc_id", "source", "repeat", "n_tokens", F.round(t, 9).alias("position")
    )


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, slope: float = 0.5, path: str = DEFAULT_FILE, schedules: dict[str, float] | None = None) -> DataFrame:
    """The chosen records: doc_id, source, repeat (0 the first use), n_tokens, position in [0, 1]; range-sorted.

    A record is chosen when its middle lies within its source's demand, so a source is off its demand by half a
    record at most. ``total`` is the mixture's size in tokens; unset, it is the largest at which no source needs more
    than ``max_repeats`` uses of a record. ``schedules`` has the slope of each source between -1 (early) and 1 (late), 0 where
    it is not named; without it ``slope`` is the steepest. Null and empty texts and unlisted or null sources are not used, copies of a
    row count once, a null share or repeat counts as 0, and an empty table gives an empty mixture.
    """
    spark, _, _, plan, sized, buckets = _plan(documents, targets, total, slope, path, schedules)
    return _chosen(spark, plan, sized, buckets).orderBy("position", "source", "doc_id", "repeat")


def report(documents: DataFrame, targets: DataFrame, total: float | None = None, slope: float = 0.5, path: str = DEFAULT_FILE, schedules: dict[str, float] | None = None) -> DataFrame:
    """Target and actual share of every listed source, those without records included."""
    spark, goal, have, plan, sized, buckets = _plan(documents, targets, total, slope, path, schedules)
    chosen = _chosen(spark, plan, sized, buckets)
    # partial sums over (source, repeat) first: a hot source is never one task's rows
    used = chosen.groupBy("source").agg(
        F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("used_records"), (F.max("repeat") + 1).alias("most_uses")
    )
    listed = [(s, share, times, have.get(s, (0, 0))[0]) for s, (share, times) in goal.items()]
    listed = spark.createDataFrame(listed, "source string, target_share double, max_repeats int, available_tokens bigint")
    out = listed.join(used, "source", "left").fillna(0, ["used_tokens", "used_records", "most_uses"])
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # at most MAX_SOURCES rows
    share = F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0))
    return out.withColumn("actual_share", F.round(share, 6))
