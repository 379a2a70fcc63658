"""Mix sources to target weights on a curriculum whose weights change over training.

Sizes are words. A source's target is its share of all words, capped at a number of passes over the source.
Its documents lie one after another on a line, in the order of a hash; the mix walks the line, again
and again, until it has taken the target. There are two lines: one of documents longer than the source's
mean, walked for their share of the target, then one of the others, which makes up the difference to within
half a short document. The weight schedule says how fast: with ``w(t)`` the source's
weight at time t of the run, 0 to 1, it has taken ``target * (integral of w up to t) / (integral of w)``
by then. Inverting that gives the time of every copy of a document, and a range sort by time the order.
Everything is DataFrame work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.llm.shared import stored
from tallyworks.operators.ranking import with_position

SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSettings:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # of the sources in order of their names, repeating
    passes: int = 3  # no source, and no document, gives more than so many times its size
    # Weight at the begin and at the end of the run, relative to the source's mean weight, repeating too.
    slopes: tuple[tuple[float, float], ...] = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def words_in(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")).cast("bigint")


def source_targets(sizes: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """(source, source_size, docs, weight, slope_from, slope_to, target) per source, null among them.

    Sources are ranked by code point, null last. Words above a source's cap are dealt out again by weight
    among the rest until none is above; each round caps at least one source. One row per source is all
    that the rounds read.
    """
    sources = stored(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "sources"
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values) + 1).cast("int"))
    sources = stored(
        sources.withColumn("rank", rank)
        .withColumn("weight", pick(settings.weights))
        .withColumn("slope_from", pick([a for a, _ in settings.slopes]))
        .withColumn("slope_to", pick([b for _, b in settings.slopes])),
        "sources",
    )
    cap = F.col("source_size") * settings.passes
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words per unit of weight
    while total:
        full = cap <= F.col("weight") * level
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if row["open"] is None:
            break
        raised = (total - row["capped"]) / row["open"]
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def place_of() -> Column:
    """Where a document lies on its source's line: a hash of its id and text, so that reruns agree."""
    return F.xxhash64(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def mix_plan(documents: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """(doc_id, place, size, source_size, target, copies, taken, times) per row of ``documents``.

    * Null and empty texts have size 0: they are taken as often as the mix walks past them, adding no words.
    * A null source is a source; a null doc_id is hashed like any other value.
    * Rows equal in id and text lie side by side and are interchangeable.
    * Copies are whole; a document gives at most ``passes`` of them. Other columns are not read.
    """
    rows = stored(
        documents.select("doc_id", "source", words_in(F.col("text")).alias("size"), place_of().alias("place")), "sizes"
    )
    facts = source_targets(rows, settings).select(
        F.col("source").alias("s"), "source_size", "docs", "slope_from", "slope_to", "target"
    )
    # Running totals in two steps, within parts and over parts, of about the root of the source's rows each.
    # The top bits of the place give the part, so parts lie one after another on the source's line.
    parts = F.greatest(F.lit(1), F.ceil(F.sqrt("docs"))).cast("bigint")
    part = F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * parts).cast("bigint")
    placed = (
        rows.join(facts, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("short", F.col("size") * F.col("docs") <= F.col("source_size"))
        .withColumn("part", F.least(part, parts - 1))
    )
    sums = placed.groupBy("s", "short", "part").agg(F.sum("size").alias("words"))
    line = Window.partitionBy("s", "short")
    before = F.sum("words").over(line.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(
        F.col("s").alias("s2"), F.col("short").alias("short2"), F.col("part").alias("part2"),
        F.coalesce(before, F.lit(0)).alias("before"), F.sum("words").over(line).alias("length"),
    )
    same_part = F.col("s").eqNullSafe(F.col("s2")) & (F.col("short") == F.col("short2")) & (F.col("part") == F.col("part2"))
    inside = Window.partitionBy("s", "short", "part").orderBy("place", "doc_id", "size")
    start = F.col("before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = stored(
        placed.join(sums, same_part)
        .withColumn("middle", start + F.col("size") / 2)
        .select("doc_id", "place", "s", "size", "source_size", "slope_from", "slope_to", "target", "short", "middle", "length"),
        "line",
    )

    def copies(goal: Column) -> Column:
        walked = F.floor((goal - F.col("middle")) / F.greatest("length", F.lit(1))) + 1
        return F.greatest(F.lit(0), F.least(F.lit(settings.passes), walked)).cast("int")

    long_goal = F.col("target") * F.col("length") / F.greatest("source_size", F.lit(1))
    taken = placed.where(~F.col("short")).withColumn("copies", copies(long_goal))
    taken = taken.groupBy("s").agg(F.sum(F.col("size") * F.col("copies")).alias("long_taken"))
    placed = placed.join(taken.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").withColumn(
        "goal", F.when(F.col("short"), F.col("target") - F.coalesce("long_taken", F.lit(0))).otherwise(long_goal)
    )
    walked = lambda k: (F.col("middle") + k * F.col("length")) / F.greatest("goal", F.lit(1e-9))
    passes = F.slice(F.array(*[F.lit(k) for k in range(settings.passes)]), F.lit(1), F.col("copies"))
    return placed.withColumn("copies", copies(F.col("goal"))).select(
        "doc_id", "place", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.transform(passes, lambda k: time_of(walked(k), F.col("slope_from"), F.col("slope_to"))).alias("times"),
    )


def time_of(done: Column, begin: Column, end: Column) -> Column:
    """When a weight that goes straight from ``begin`` to ``end`` has spent the fraction ``done`` of its integral.

    Solves ``begin * t + (end - begin) * t * t / 2 = done * (begin + end) / 2`` in the form that stays
    exact when the weight is constant.
    """
    spent = F.least(F.greatest(done, F.lit(0.0)), F.lit(1.0)) * (begin + end) / 2
    return 2 * spent / (begin + F.sqrt(F.greatest(begin * begin + 2 * (end - begin) * spent, F.lit(0.0))))


def mixed(documents: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The training order: every copy as a row of ``documents`` plus ``mix_time`` (0 to 1), range-sorted by it.

    Rows equal in id and text count as one document with the copies of all. A column of ``documents`` that
    is itself called ``mix_time`` is replaced.
    """
    plan = mix_plan(documents, settings).where("copies > 0")
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).agg(
        F.flatten(F.collect_list("times")).alias("_times")
    )
    rows = documents.withColumn("_at", place_of()).dropDuplicates(["doc_id", "_at"])
    copies = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_place")))
    names = [F.col(f"`{name}`") for name in documents.columns if name != "mix_time"]
    copies = copies.select(*names, F.explode("_times").alias("mix_time"))
    return copies.repartitionByRange("mix_time", "doc_id").sortWithinPartitions("mix_time", "doc_id")


def mixture(documents: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_time, first_step) per row of ``documents``, read off the mix.

    Every copy is a row of the training order, without its text: range-sorted by time as in ``mixed`` and numbered
    from 1 over the cluster. What a document gives is counted there; one that the mix doesn't take gives 0 words.
    """
    plan = stored(mix_plan(documents, settings).withColumn("_row", F.monotonically_increasing_id()), "plan")
    copies = plan.select("_row", "doc_id", "place", "size", F.explode("times").alias("mix_time"))
    order = [F.col(name) for name in ("mix_time", "doc_id", "place", "size", "_row")]
    given = with_position(copies, order, "step").groupBy(F.col("_row").alias("_given")).agg(
        F.sum("size").alias("words"), F.min("mix_time").alias("first_time"), F.min("step").alias("first_step")
    )
    return plan.join(given, F.col("_row") == F.col("_given"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"),
        "first_time", "first_step",
    )
