"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Sources in code point order (null last) weigh ``rates``, repeating, and share
``percent`` of all words. A target stops at ``most_epochs`` times its source's size; the
excess is shared again by weight until none is above. A target first takes complete
epochs of its source; the rest goes to the documents of the smallest exponential keys
-ln(u) / quality weight, u being hashed from the id, whose running sizes reach it: a
document is taken if its middle lies within the rest.

The point where a source's running size reaches the rest is found from a histogram of
its keys; only the bin with that point is sorted, so a source with a third of all rows
is never one task's sort. What the plan keeps is a row for each source.

Defined results: a null text has size 0, and a size of 0 takes 0; null sources are one
source, last in order; a null id is hashed as empty and sorts first among equal keys; a null or
non-positive weight counts as 1; repeated rows have equal keys and are taken one by one, those at the
edge in the order of their content; an empty table gives an empty result. Input columns beside those named are not read by ``plan``, and
``apply`` uses names that start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import WORD, cut, small, unit_hash

BINS = 1024
SMALL = 10_000  # sources; a table of no more rows is broadcast


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(name: Column, weight: Column, seed: int) -> Column:
    """Exponential key: the smaller, the sooner it is taken."""
    return -F.log(unit_hash(name, F.lit(seed))) / F.when(weight > 0, weight).otherwise(F.lit(1.0))


def targets(rows: DataFrame, rates: tuple[int, ...] = (3, 1, 2), percent: int = 150, most_epochs: int = 2) -> DataFrame:
    """source, source_size, mean_weight and target; ``rows`` has source, size and weight."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0)).alias("mean_weight"))
    per = cut(per)
    # A row for each source from here on.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rate", F.element_at(F.array(*map(F.lit, rates)), F.pmod(place - 1, F.lit(len(rates))) + 1)).withColumn("cap", most_epochs * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("rate"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * (percent / 100)
    full = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("budget") - F.col("full")) / F.sum("rate").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    filled = per.withColumn("budget", budget).withColumn("full", full).withColumn("level", level).withColumn("capped", F.col("cap") / F.col("rate") <= F.col("level"))
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    return filled.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(common * F.col("rate"))).select("source", "source_size", "mean_weight", "target")


def _bin() -> Column:
    return F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean_weight"))) * BINS).cast("int"), F.lit(BINS - 1))


def plan(rows: DataFrame, **options) -> DataFrame:
    """A row for each source: source_size, mean_weight, target, epochs, and where its fraction ends (last_bin, last).

    ``rows`` has doc_id, source, size, weight and key, and is read several times: pass it stored.
    """
    goal = targets(rows, **options)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    binned = rows.select("doc_id", "source", "size", "key").alias("r").join(_small(goal).alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", "rest", _bin().alias("bin"))
    counted = binned.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    start = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    edge = cut(counted.withColumn("start", start).where("start < rest and rest <= start + words").select("source", F.col("bin").alias("last_bin"), "start"))
    within = F.sum("size").over(Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    near = binned.alias("b").join(_small(edge).alias("e"), F.col("b.source").eqNullSafe(F.col("e.source")) & (F.col("bin") == F.col("last_bin"))).select("b.*", "start")
    before = F.col("start") + within - F.col("size")
    fits = (2 * before + F.col("size") <= 2 * F.col("rest")).cast("int")
    equal = near.withColumn("fits", fits).groupBy("source", "key", "doc_id", "size").agg(F.sum("fits").alias("some"), F.count("*").alias("all")).where("some > 0")
    last = equal.groupBy("source").agg(F.max(F.struct("key", "doc_id", "size", "some", "all")).alias("last"))
    ends = edge.alias("e").join(last.alias("l"), F.col("e.source").eqNullSafe(F.col("l.source")), "left").select("e.source", "last_bin", "last")
    return cut(goal.alias("g").join(ends.alias("e"), F.col("g.source").eqNullSafe(F.col("e.source")), "left").select("g.source", "source_size", "mean_weight", "target", "epochs", "last_bin", "last"))


def _small(per_source: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, and left to the planner if not."""
    return F.broadcast(per_source) if per_source.limit(SMALL + 1).count() <= SMALL else per_source


def apply(rows: DataFrame, planned: DataFrame, content: Column | None = None) -> DataFrame:
    """``rows`` (with doc_id, source, size, key) with source_size, target and copies, how often the mix takes each row.

    Where only some of the rows of one id, size and source fit, the first by ``content`` are taken.
    """
    p = planned.select(F.col("source").alias("_mix_source"), "source_size", "mean_weight", "target", "epochs", "last_bin", "last")
    joined = rows.join(_small(p), F.col("source").eqNullSafe(F.col("_mix_source")))
    own, last = F.struct("key", "doc_id", "size"), F.struct("last.key", "last.doc_id", "last.size")
    here = _bin() == F.col("last_bin")
    inside = (_bin() < F.col("last_bin")) | (here & (own <= last))
    with_copies = lambda df, extra: df.withColumn("copies", F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("int")).drop("_mix_source", "mean_weight", "epochs", "last_bin", "last")
    if planned.where("last.some < last.all").isEmpty():
        return with_copies(joined, inside)
    split = F.coalesce(here & (own <= last) & ~(own < last) & (F.col("last.some") < F.col("last.all")), F.lit(False))
    nth = F.row_number().over(Window.partitionBy("source", "key", "doc_id", "size").orderBy(F.lit(0) if content is None else content))
    edge = joined.where(split).withColumn("_mix_nth", nth)
    return with_copies(joined.where(~split), inside).unionByName(with_copies(edge, F.col("_mix_nth") <= F.col("last.some")).drop("_mix_nth"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id and weight: 2 for rows labelled good, 0.5 for bad; a bad label wins over a good one."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.min("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def _keyed(rows: DataFrame, weights: DataFrame, seed: int) -> DataFrame:
    """``rows`` with weight and key, by doc_id; ``weights`` is broadcast if it is small, so that texts need no shuffle."""
    return rows.join(weights, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("key", key_of(F.coalesce(F.col("doc_id").cast("string"), "_mix_name"), F.col("weight"), seed)).drop("_mix_name")


def _sized(documents: DataFrame, *more: Column) -> DataFrame:
    name = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("_mix_name")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), name, *more)


def mix(documents: DataFrame, labels: DataFrame, seed: int = 17, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every document."""
    rows = cut(_keyed(_sized(documents), small(cut(quality_weights(labels))), seed))
    done = apply(rows, plan(rows, **options))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(documents: DataFrame, labels: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The rows of ``documents`` as often as the mix takes them, with their own columns."""
    weights = small(cut(quality_weights(labels)))
    planned = plan(cut(_keyed(_sized(documents), weights, seed)), **options)
    packed = _sized(documents, F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_mix_row"))
    taken = apply(_keyed(packed, weights, seed), planned, F.xxhash64("_mix_row")).where("copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_mix_row.*")
