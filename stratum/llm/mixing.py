"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral over time is the source's
share, and scaled by the source's target it is the source's cumulative demand of tokens, D(t). A source's documents,
in a fixed pseudo-random order and repeated in epochs, fill its own token axis; the copy of a document that starts
at token x is taken if its middle lies below the target, and is trained at position D^-1(x). Copies are then range-sorted by
position; what a document gives to the mix is summed from its copies there. Prefix sums run in two levels, (source, bucket of the
order) and inside a bucket, about the square root of the rows each, so that no window holds a whole source, however hot.

Defined results: a null text has size 0 and takes 0 words; a null source is a source of its own, last by code
point; an empty table gives no rows; a source of size 0 has target 0; repeated rows are documents of their own.
Extra columns stay, output columns replace those of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Weight schedules by rank of the source: (time, relative weight) knots. Heavy sources fade, light ones grow.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> plus _m_rank, weight and target.

    Targets are proportional to weight and stop at max_repeat times the source's size; the excess goes to the
    others by weight until none is above. The fixed point has one level L with target = min(cap, L * weight): sources
    are ranked by cap / weight, and the level is found from running sums. One row per source enters the window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_m_rank", F.row_number().over(by_name) - 1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = ranked.withColumn("weight", F.get(w, F.pmod(F.col("_m_rank"), F.lit(len(weights))))).withColumn("_m_cap", F.col("source_size") * F.lit(float(max_repeat)))
    ranked = ranked.withColumn("_m_level", F.col("_m_cap") / F.col("weight"))
    by_level = Window.orderBy("_m_level", "_m_rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_m_level", "_m_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    before, weight_before = F.coalesce(F.sum("_m_cap").over(by_level), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    level = (budget - before) / (F.sum("weight").over(everything) - weight_before)
    leveled = ranked.withColumn("_m_try", F.when(level <= F.col("_m_level"), level))
    # The first source, by level, whose cap is not reached sets the level of all after it.
    fixed = leveled.withColumn("_m_at", F.first("_m_try", ignorenulls=True).over(everything))
    target = F.when(F.col("_m_at").isNull(), F.col("_m_cap")).otherwise(F.least(F.col("_m_cap"), F.col("_m_at") * F.col("weight")))
    return fixed.withColumn("target", F.greatest(target, F.lit(0.0))).select("source", "source_size", "weight", "target", "_m_rank")


def _normalised(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Segments (start, weight at start, slope, integral before) of a schedule scaled to integral 1 over 0..1."""
    knots = [(float(t), float(w)) for t, w in schedule]
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots) or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])):
        raise ValueError("a schedule needs non-negative weights at increasing times from 0 to 1")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for (t, w), (u, v) in zip(knots, knots[1:]):
        out.append((t, w / area, (v - w) / area / (u - t), done))
        done += (u - t) * (w + v) / 2 / area
    return out


def position(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which a source has met ``share`` (0..1) of its demand: inverse of the integrated schedule."""
    out = None
    for k, schedule in enumerate(schedules):
        time = None
        for start, weight, slope, done in _normalised(schedule):
            x = F.greatest(share - F.lit(done), F.lit(0.0))
            # weight * s + slope / 2 * s^2 = x, in the form without cancellation.
            s = F.when(x == 0, F.lit(0.0)).otherwise(2 * x / (F.lit(weight) + F.sqrt(F.greatest(F.lit(weight * weight) + 2 * F.lit(slope) * x, F.lit(0.0)))))
            time = F.lit(start) + s if time is None else F.when(share >= F.lit(done), F.lit(start) + s).otherwise(time)
        here = F.least(time, F.lit(1.0))
        out = here if out is None else F.when(F.pmod(rank, F.lit(len(schedules))) == k, here).otherwise(out)
    return out


def assign(
    docs: DataFrame,
    size: Column | None = None,
    source: str = "source",
    id: str = "doc_id",
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    max_repeat: int = MAX_REPEAT,
    share: float = 1.0,
    digits: int | None = None,
) -> DataFrame:
    """docs plus size, source_size, target, copies (int), taken (long) and positions (array<double>, one per copy).

    The order of a source's documents is that of the MD5 of their ids, of which the first ``digits`` choose the bucket.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))
    df = docs.withColumns({"size": size, "_m_key": key, "_m_hash": F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))})
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, docs.count()), 16) / 2))
    df = df.withColumn("_m_bucket", F.substring("_m_hash", 1, digits))
    per_bucket = df.groupBy("_m_key", "_m_bucket").agg(F.sum("size").alias("_m_sum"), F.first(F.col(source)).alias("source"))
    # One row a bucket of a source meets in this window.
    before = Window.partitionBy("_m_key").orderBy("_m_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_m_before", F.coalesce(F.sum("_m_sum").over(before), F.lit(0)))
    sources = per_bucket.groupBy("_m_key").agg(F.sum("_m_sum").alias("source_size"), F.first("source").alias("source"))
    goals = targets(sources.select("source", "source_size"), weights, max_repeat, share)
    goals = goals.withColumn("_m_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).drop("source")
    side = offsets.join(goals, "_m_key").select("_m_key", "_m_bucket", "_m_before", F.col("source_size").alias("_m_size"), F.col("target").alias("_m_target"), "_m_rank")
    inside = Window.partitionBy("_m_key", "_m_bucket").orderBy("_m_hash", F.col(id), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_m_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(side, ["_m_key", "_m_bucket"]).withColumn("_m_start", F.col("_m_start") + F.col("_m_before"))
    # Copy k covers tokens [k * S + start, k * S + start + size) of its source and is taken if its middle is below the target.
    middle = F.col("_m_start") + F.col("size") / 2
    copies = F.when((F.col("size") > 0) & (F.col("_m_size") > 0), F.least(F.lit(max_repeat), F.greatest(F.lit(0), F.ceil((F.col("_m_target") - middle) / F.col("_m_size"))))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumns({"source_size": F.col("_m_size"), "target": F.col("_m_target"), "copies": copies})
    at = F.transform(
        F.sequence(F.lit(0), F.col("copies") - 1),
        lambda k: position(F.least((k * F.col("source_size") + F.col("_m_start")) / F.col("target"), F.lit(1.0)), F.col("_m_rank"), schedules),
    )
    positions = F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>"))
    placed = placed.withColumns({"taken": F.col("copies") * F.col("size"), "positions": positions})
    return placed.drop("_m_key", "_m_bucket", "_m_hash", "_m_start", "_m_before", "_m_size", "_m_target", "_m_rank")


def in_order(copies: DataFrame, id: str, partitions: int | None = None) -> DataFrame:
    """Copies (_m_position) range-sorted by training position."""
    n = partitions or int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartitionByRange(n, "_m_position", id).sortWithinPartitions("_m_position", id)


def mixed(docs: DataFrame, source: str = "source", id: str = "doc_id", **options) -> DataFrame:
    """docs (with a size) as the mix uses them: source_size, target, and from the copies in training order taken, copies and first_position."""
    rows = materialize(docs.withColumn("_m_row", F.monotonically_increasing_id()), "mix-sizes")
    placed = materialize(assign(rows, F.col("size"), source, id, **options).drop("copies", "taken"), "mix-placed")
    copies = in_order(placed.select("_m_row", F.col(id), "size", F.explode("positions").alias("_m_position")), id)
    trained = copies.filter(F.col("_m_position").between(0.0, 1.0)).groupBy(F.col("_m_row").alias("_m_of"))
    trained = trained.agg(F.sum("size").alias("_m_taken"), F.count(F.lit(1)).cast("int").alias("_m_copies"), F.min("_m_position").alias("first_position"))
    out = placed.drop("positions").join(trained, F.col("_m_row") == F.col("_m_of"), "left")
    return out.withColumns({"taken": F.coalesce("_m_taken", F.lit(0)).cast("long"), "copies": F.coalesce("_m_copies", F.lit(0))}).drop("_m_row", "_m_of", "_m_taken", "_m_copies")


def training_order(docs: DataFrame, partitions: int | None = None, text: str = "text", source: str = "source", id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: one row per copy of a document, columns of docs, range-sorted by training position.

    Documents without words have nothing to train on and leave.
    """
    # The row travels whole, so that no column of docs meets one that assign() adds.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_m_row"), F.col(id), F.col(source))
    placed = assign(packed, word_count(F.col("_m_row")[text]), source, id, **options)
    rows = placed.select(F.col("_m_row.*"), F.explode("positions").alias("_m_position"))
    return in_order(rows, id, partitions).drop("_m_position")


def position_sql(share: str, rank: str, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> str:
    """position() as SQL."""
    cases = []
    for k, schedule in enumerate(schedules):
        time = ""
        for start, weight, slope, done in _normalised(schedule):
            x = f"greatest({share} - {done!r}::DOUBLE, 0.0::DOUBLE)"
            s = f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE 2 * {x} / ({weight!r}::DOUBLE + sqrt(greatest({weight * weight!r}::DOUBLE + {2 * slope!r}::DOUBLE * {x}, 0.0::DOUBLE))) END"
            time = f"{start!r}::DOUBLE + {s}" if not time else f"CASE WHEN {share} >= {done!r}::DOUBLE THEN {start!r}::DOUBLE + {s} ELSE {time} END"
        cases.append(f"WHEN {rank} % {len(schedules)} = {k} THEN least({time}, 1.0::DOUBLE)")
    return f"CASE {' '.join(cases)} END"


def mix_sql(weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> str:
    """The mix of documents as SQL, as op1_mixing returns it."""
    weight = " ".join(f"WHEN r % {len(weights)} = {k} THEN {float(w)!r}::DOUBLE" for k, w in enumerate(weights))
    most = float(max_repeat)
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s),
w AS (SELECT *, CASE {weight} END AS weight, source_size * {most!r}::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / weight AS level FROM w),
t AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS reach
  FROM l WINDOW b AS (ORDER BY level, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT reach FROM t WHERE reach <= level ORDER BY level, r LIMIT 1) AS common FROM t),
g AS (SELECT source, source_size, r, greatest(CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END, 0.0::DOUBLE) AS target FROM f),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
c AS (SELECT p.doc_id, p.size, p.start, g.source_size, g.target, g.r,
  CASE WHEN size > 0 AND g.source_size > 0 THEN least({int(max_repeat)}, greatest(0, CAST(ceil((g.target - (start + size / 2)) / g.source_size) AS INTEGER))) ELSE 0 END AS copies
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
  CASE WHEN copies > 0 THEN {position_sql('least(start / target, 1.0::DOUBLE)', 'r')} END AS first_position FROM c"""
