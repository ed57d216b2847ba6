"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

A source's target is its weight's share of the wanted size, clamped at `max_epochs` times its own size; what is clamped away goes
to the others by weight until no target is above its clamp. Sources sorted by clamp over weight make that a single pass: those
below the water level are clamped, the rest share what remains. Every document is then taken floor(rate) times, and the
fractional rest of the rate is met by the documents whose seeded hash is lowest, cut where their summed sizes come nearest to it.

Defined results: a null text has size 0; null is a source of its own, last in order; a source without words gets target 0 and its
documents are taken 0 words; an empty table gives an empty result; repeated rows (same doc_id and text) share a hash and are taken alike; extra
columns pass through unless they clash with a result column, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtally.llm.shared import WORD, join_small, pack, unpack, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20_240_607
#: Documents that one bucket of a source's seeded order holds on average.
BUCKET_ROWS = 4_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: one row per source with source_size and docs. Adds weight, cap, target. The table has a row per source, never per document."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs).withColumn("total", F.sum("source_size").over(everything))
    level = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    after = level.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("clamped_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(after))
    # The share of this source if all before it in the order are clamped; it is clamped itself when that is more than its clamp.
    share = F.col("weight") * ((F.col("total") - F.col("clamped_before")) / F.col("weight_left"))
    ranked = ranked.withColumn("open", share <= F.col("cap"))
    first = ranked.withColumn("water", F.min(F.when(F.col("open"), F.struct("clamped_before", F.col("total").alias("t"), "weight_left"))).over(everything))
    water = F.col("weight") * ((F.col("water.t") - F.col("water.clamped_before")) / F.col("water.weight_left"))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("cap").cast("double"), F.coalesce(water, F.col("cap").cast("double"))))
    return first.select("source", "source_size", "docs", "weight", target.alias("target"))


def plan_mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Adds size, source_size, target and copies (how often the document is taken) to df."""
    own, row = pack(df, ("size", "source_size", "target", "copies"))
    body = F.col("text")
    sized = df.select(*row, F.col("source").alias("source"), word_count(body).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), body).alias("_u"))
    # The words of the texts are counted here, and once more for the result.
    light = written(sized.select("source", "size", "_u"), "sizes")
    per_source = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(per_source, weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_whole", F.least(F.floor(rate), F.lit(max_epochs)).cast("long"))
    targets = targets.withColumn("_rest", F.greatest(F.lit(0.0), F.col("target") - F.col("_whole") * F.col("source_size")))
    targets = targets.withColumn("_buckets", F.ceil(F.col("docs") / BUCKET_ROWS).cast("long"))
    spark = df.sparkSession
    # A row per source: brought to the driver's plan once, so that the texts are not counted again for each use.
    n_sources, targets = _pinned(spark, targets)

    # The seeded order of a source in buckets of bounded size: sums per bucket find the one that holds the cut, and only its rows are sorted.
    bucket = F.pmod(F.col("_u"), F.lit(1 << 30))
    dealt = join_small(light, targets.where("_rest > 0").select("source", "_rest", "_buckets"), "source", "inner", n_sources)
    dealt = dealt.withColumn("_b", F.floor(bucket * F.col("_buckets") / F.lit(1 << 30)).cast("long"))
    sums = dealt.groupBy("source", "_b").agg(F.sum("size").alias("bucket_size"), F.first("_rest").alias("_rest"))
    run = Window.partitionBy("source").orderBy("_b")
    sums = sums.withColumn("_end", F.sum("bucket_size").over(run)).withColumn("_start", F.col("_end") - F.col("bucket_size"))
    holds = sums.where("_start < _rest and _rest <= _end").groupBy("source").agg(F.min("_b").alias("_at"), F.min_by("_start", "_b").alias("_start"))
    n_holds, holds = _pinned(spark, holds)
    inside = join_small(dealt, holds, "source", "inner", n_holds).where("_b = _at")
    alike = inside.groupBy("source", "_u").agg(F.sum("size").alias("s"), F.first("_rest").alias("_rest"), F.first("_start").alias("_start"), F.first("_at").alias("_at"), F.first("_buckets").alias("_buckets"))
    alike = alike.withColumn("_p", F.pmod(F.col("_u"), F.lit(1 << 30)))
    along = Window.partitionBy("source").orderBy("_p", "_u")
    alike = alike.withColumn("_end", F.col("_start") + F.sum("s").over(along))
    # A document belongs to the cut when more than half of it lies before the wanted size.
    cut = alike.where(F.col("_end") - F.col("s") / 2 <= F.col("_rest")).groupBy("source").agg(F.max(F.struct("_p", "_u")).alias("_last"))
    cut = holds.join(cut, holds["source"].eqNullSafe(cut["source"]), "left").select(holds["source"], "_at", F.col("_last._p").alias("_lp"), F.col("_last._u").alias("_lu"))
    n_cuts, cut = _pinned(spark, cut)
    facts = targets.join(cut, targets["source"].eqNullSafe(cut["source"]), "left").drop(cut["source"])

    sized = sized.withColumnRenamed("source", "_source")
    facts = facts.withColumnRenamed("source", "_source")
    out = join_small(sized, facts.select("_source", "source_size", "target", "_whole", "_buckets", "_at", "_lp", "_lu"), "_source", "left", n_sources)
    own_bucket = F.floor(bucket * F.col("_buckets") / F.lit(1 << 30)).cast("long")
    below = (bucket < F.col("_lp")) | ((bucket == F.col("_lp")) & (F.col("_u") <= F.col("_lu")))
    extra = F.when(own_bucket < F.col("_at"), 1).when((own_bucket == F.col("_at")) & below, 1).otherwise(0)
    return out.select(*unpack(own), "size", "source_size", "target", F.least(F.lit(max_epochs), F.col("_whole") + extra).cast("long").alias("copies"))


def _pinned(spark, small: DataFrame) -> tuple[int, DataFrame]:
    """A table with a row per source, cut off from its lineage by the shared folder, and its number of rows."""
    kept = written(small.coalesce(1), "mix")
    return kept.count(), kept


def mix(df: DataFrame, **parameters) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, with the columns of df."""
    own, row = pack(df)
    planned = plan_mix(df.select(*row, "doc_id", "text", "source"), **parameters)
    return planned.where("copies > 0").select("_row", F.explode(F.expr("sequence(1, copies)")).alias("_n")).select(*unpack(own))
