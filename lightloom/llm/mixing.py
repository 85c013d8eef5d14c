"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source shuffles its documents (by the md5 of the id) and serves them over and over, up to ``max_passes`` times.
A copy's virtual finish time is the words its source has served up to and with it, divided by the source's weight;
the mix is all copies in order of that time, cut where the words reach the budget (the words of all documents).
A source that runs dry leaves its share to the others, which is the capped re-sharing of the targets.

Prefix sums go over two levels (about sqrt(n) hash buckets, then the rows of a bucket), so that neither a source with a
third of all rows nor the global order ever meets in one task.

Defined results: null text has size 0, null sources are one source (last); rows that repeat are documents of their own;
documents of size 0 take 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_plain_words, stored

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3


def _order_key(doc_id: str) -> F.Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def source_plan(sizes: DataFrame, weights: tuple, max_passes: int) -> DataFrame:
    """One row a source: its weight, size and target. Water filling: sources sorted by the level at which they are
    full; the level is the first that the rest can hold."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = (
        ranked.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_passes)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("full_at", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    return (
        capped.withColumn("level", level)
        .withColumn("budget", budget)
        .withColumn("fits", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level")))
        .withColumn("level", F.min("fits").over(everything)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target", "budget")
    )


def plan_mixture(docs: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row a document: doc_id, source, key, size, source_size, target, copies, taken (words, repeats counted)."""
    sizes = stored(
        docs.select("doc_id", "source", _order_key("doc_id").alias("key"), count_plain_words(F.col("text")).alias("size")),
        "mix-sizes",
    )
    buckets = max(1, math.isqrt(sizes.count()))
    part = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int")
    placed = sizes.withColumn("bucket", part)

    sources = source_plan(sizes, weights, max_passes)
    by_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("offset", F.coalesce(F.sum("words").over(by_source), F.lit(0)))
        .join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset", "source_size", "weight", "target", "budget")
    )
    in_bucket = (
        Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    )
    passes = F.sequence(F.lit(0), F.lit(max_passes - 1))
    served = stored(
        placed.withColumn("own", F.sum("size").over(in_bucket))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .withColumn("done", F.col("offset") + F.col("own"))
        .withColumn("finish", F.transform(passes, lambda e: (e * F.col("source_size") + F.col("done")) / F.col("weight"))),
        "mix-served",
    )
    cut = _finish_of_last(served, buckets)
    copies = F.size(F.filter("finish", lambda t: t <= cut))
    return served.withColumn("copies", copies).select(
        "doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def _finish_of_last(served: DataFrame, buckets: int) -> float:
    """The largest virtual finish time up to which all copies together fit the budget.

    The global order is cut into ranges of finish time; only the range in which the budget runs out is summed row by row.
    """
    edge = served.agg(F.max(F.element_at("finish", -1)), F.max("budget")).first()
    latest, budget = edge[0] or 0.0, edge[1] or 0
    span = latest / buckets or 1.0
    copies = served.select("size", F.explode("finish").alias("finish")).withColumn("range", F.floor(F.col("finish") / span))
    running = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ranges = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(running))
    over = ranges.filter(F.col("upto") > budget).orderBy("range").select("range", F.col("upto") - F.col("words")).first()
    if over is None:
        return latest
    peers = Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    inside = copies.filter(F.col("range") == over[0]).withColumn("upto", F.sum("size").over(peers) + over[1])
    last = inside.filter(F.col("upto") <= budget).agg(F.max("finish")).first()[0]
    return last if last is not None else math.nextafter(over[0] * span, -math.inf)


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``.

    Within a source the last pass is a prefix of the shuffled order, so a source needs only its full passes and the key
    at which the last pass ends: texts are not shuffled. Documents of size 0 are in no mix.
    """
    plan = plan_mixture(docs, weights, max_passes).filter("size > 0")
    key = F.struct("key", "doc_id")
    ends = plan.groupBy("source").agg(F.min("copies").alias("full"), F.max("copies").alias("most"))
    last = plan.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    last = stored(
        last.groupBy(F.col("source").alias("mix_source"))
        .agg(
            F.min("full").alias("mix_full"),
            F.max(F.when(F.col("copies") > F.col("full"), key)).alias("mix_last"),
        ),
        "mix-ends",
    )
    whole = docs.select(F.struct("*").alias("d"))  # nested, so that no other column's name can clash
    own = F.struct(_order_key("d.doc_id").alias("key"), F.col("d.doc_id"))
    copies = F.col("mix_full") + F.coalesce((own <= F.col("mix_last")).cast("int"), F.lit(0))
    keep = (count_plain_words(F.col("d.text")) > 0) & (copies > 0)
    joined = whole.join(last, F.col("d.source").eqNullSafe(F.col("mix_source"))).filter(keep)
    return joined.select("d", F.explode(F.sequence(F.lit(1), copies))).select("d.*")
