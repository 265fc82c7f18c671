"""Mixing sources to target weights by Pareto order sampling.

A source's target sets the expected copies e of its documents. Each document gets
floor(e) certain whole copies; one more goes to a sample drawn with inclusion
probability p = e - floor(e). Pareto order sampling (Rosen, 1997) ranks documents by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and takes the smallest
until the sample has its fixed size, here counted in words. ``u`` is a hash of the
document id, so reruns and lost tasks draw alike.

Ranks are compared with one cut per source, so documents are never sorted or moved: the
sizes are summed per source and per narrow range of ranks, running sums over the ranges
find the one that holds the cut, and only that one is ordered. Sources are numbered by
range partitioning; targets need one row of sums per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.operators.keys import dense_id
from citegrid.session import Scratch

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
# Ranges of ranks that a source is summed by.
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST_COPIES, scratch: Scratch | None = None) -> DataFrame:
    """``(source, source_size, weight, target)``; ``sized`` has ``source`` and ``size``.

    Sources are ordered by code point, null last. Targets share ``share`` times all words
    by weight; a target above ``most`` times its source stops there and the rest is
    shared again among the others, until none is above.
    """
    scratch = scratch or Scratch(sized.sparkSession, "source-targets")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = dense_id(sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_n", start=0,
                        scratch=scratch)
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    table = scratch.save(numbered.select("source", "source_size", choice.cast("double").alias("weight")), "sources")
    room = F.col("source_size") * float(most)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * level > room
        row = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, room)).alias("used"),
                        F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        now = ((row["all"] or 0) * share - (row["used"] or 0.0)) / row["open"]
        if now == level:
            break
        level = now
    goal = F.col("weight") * (level or 0.0)
    return table.withColumn("target", F.when(goal > room, room).otherwise(goal))


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``whole`` copies and ``rank`` in (0, 1); null rank: no further copy is possible."""
    expected = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("scale") * F.col("lean")))
    rows = rows.withColumn("expected", F.coalesce(expected, F.lit(0.0)))
    rows = rows.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1.0 - F.col("u"))) / (F.col("p") / (1.0 - F.col("p")))
    return rows.withColumn("rank", F.when(F.col("p") > 0, odds / (1.0 + odds)))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
             lean: str | None = None, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """One row per source: its target and the cut that its sample takes.

    ``lean`` names a column that scales a document's expected copies within its source
    (null or not above 0: 0); without it documents of a source are alike.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(_sized(docs, lean, seed), "sized")
    goals = scratch.save(source_targets(sized, weights, share, most, scratch), "goals")
    rows = sized.join(goals, sized.source.eqNullSafe(goals.source)).drop(goals.source)
    # Expected copies stop at ``most``; what that leaves goes to the other documents.
    scale = goals.select("source", F.lit(0.0).alias("scale"))
    while True:
        stopped = F.col("scale") * F.col("lean") > float(most)
        now = (
            rows.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source", "target", "scale")
            .agg(F.sum(F.when(stopped, F.col("size") * float(most)).otherwise(0.0)).alias("used"),
                 F.sum(F.when(stopped, 0.0).otherwise(F.col("size") * F.col("lean"))).alias("open"))
            .select("source", F.col("scale").alias("last"), F.when(
                F.col("open") > 0, (F.col("target") - F.col("used")) / F.col("open"))
                .otherwise(F.col("scale")).alias("scale")))
        scale, seen = scratch.measure(now, "scale", F.max(F.col("scale") - F.col("last")).alias("up"))
        scale = scale.select("source", "scale")
        if lean is None or not (seen["up"] or 0.0) > 1e-9:
            break
    scaled = scratch.save(goals.join(scale.withColumnRenamed("source", "_s"),
                                     F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "scaled")
    drawn = _drawn(sized.join(scaled.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
                   .drop("_s"), most).withColumn("range", F.floor(F.col("rank") * RANGES).cast("int"))

    # Words that the sample is to have, and the range of ranks where it ends.
    sums = scratch.save(drawn.groupBy("source", "range").agg(
        F.sum(F.col("whole") * F.col("size")).alias("whole"),
        F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words")), "sums")
    wanted = sums.groupBy("source").agg(F.sum("whole").alias("whole")).join(
        scaled.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "_s", (F.round("target").cast("bigint") - F.col("whole")).alias("need"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        sums.where("range IS NOT NULL").withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(wanted, F.col("source").eqNullSafe(F.col("_s")))
        .where(F.col("before") < F.col("need")))
    edges = scratch.save(ranges.groupBy(F.col("_s")).agg(
        F.max("need").alias("need"), F.max("range").alias("edge"), F.max("before").alias("before")), "edges")
    inside = drawn.join(edges, F.col("source").eqNullSafe(F.col("_s"))).where(F.col("range") <= F.col("edge"))
    order = Window.partitionBy("source").orderBy("rank", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ordered = inside.where("range = edge").withColumn(
        "ahead", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # The document at the cut is taken if that comes nearer to the target.
    cuts = scratch.save(ordered.groupBy("source", "need", "edge", "before").agg(
        F.max(F.when(2 * F.col("ahead") + F.col("size") <= 2 * F.col("need"), F.col("rank"))).alias("last")).select(
        F.col("source").alias("_s"), "need",
        F.coalesce("last", F.col("edge") / F.lit(float(RANGES)) - 1e-12).alias("cut")), "cuts")

    # One document per source may change sides, the one that brings the total nearest.
    sides = drawn.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn(
        "taken", F.coalesce(F.col("rank") <= F.col("cut"), F.lit(False)))
    total = scratch.save(sides.where("taken").groupBy("source").agg(F.sum("size").alias("words")), "total")
    short = cuts.join(total, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("_s").alias("_t"), (F.col("need") - F.coalesce("words", F.lit(0))).alias("short"))
    change = F.when(F.col("taken"), -F.col("size")).otherwise(F.col("size"))
    swaps = (
        sides.where("rank IS NOT NULL").join(short, F.col("source").eqNullSafe(F.col("_t")))
        .withColumn("left", F.abs(F.col("short") - change)).where(F.col("left") < F.abs("short"))
        .groupBy("source").agg(F.min(F.struct("left", "rank")).alias("best"))
        .select(F.col("source").alias("_t"), F.col("best.rank").alias("swap")))
    plan = scratch.save(
        scaled.join(cuts.select("_s", "cut"), F.col("source").eqNullSafe(F.col("_s")), "left")
        .join(swaps, F.col("source").eqNullSafe(F.col("_t")), "left")
        .select("source", "source_size", "target", "scale", "cut", "swap"), "plan")
    scratch.drop("sized", "goals", "sources", "scale", "scaled", "sums", "edges", "cuts", "total")
    return plan


def _sized(docs: DataFrame, lean: str | None, seed: str, keep: bool = False) -> DataFrame:
    """What the draw needs of each row; with ``keep`` also the row itself."""
    factor = F.lit(1.0) if lean is None else F.greatest(F.coalesce(F.col(lean).cast("double"), F.lit(0.0)), F.lit(0.0))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    return docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"),
                       factor.alias("lean"), uniform(F.col("doc_id"), seed).alias("u"), *row)


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``copies`` from the drawn columns and the plan's cut."""
    sampled = F.coalesce(F.col("rank") <= F.col("cut"), F.lit(False))
    swapped = F.coalesce(F.col("rank") == F.col("swap"), F.lit(False))
    return _drawn(rows, most).withColumn("copies", (F.col("whole") + (sampled != swapped).cast("int")).cast("int"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
               lean: str | None = None, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, copies)``, one row per input row.

    A null source is a source of its own, the last. Null and blank texts have size 0 and
    add nothing; a source without words has target 0. Rows that repeat a ``doc_id`` draw
    alike. Ties in rank go by size, then id. An empty table gives an empty result;
    further columns are not read.
    """
    plan = mix_plan(docs, weights, share, most, lean, seed, scratch)
    rows = _sized(docs, lean, seed).join(
        plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return _copies(rows, most).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES,
        lean: str | None = None, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, columns unchanged."""
    plan = mix_plan(docs, weights, share, most, lean, seed, scratch)
    rows = _sized(docs, lean, seed, keep=True).join(
        plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    return (_copies(rows, most).where("copies > 0")
            .withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select("row.*"))
