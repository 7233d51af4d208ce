"""Mixing sources to target weights, by capped water-filling.

A source can give at most its tokens times ``max_repeats``. Sources whose share exceeds that are clamped, and what they
lack goes to the others in proportion to their weights, until no source exceeds its cap. In the order of cap over weight
the clamped sources come first, so running sums find them in one pass. Each source then repeats all of its documents a
whole number of times, and a seeded sample of them once more; running sums over hash buckets hit the token target to
within one document without ordering a source in one task.

Source names compare trimmed, in lower case, with runs of blanks, '-' and '_' made one '_'; null and blank sources have
no target. Targets of one name add up, the largest max_repeats holding; null weights count as 0 and null repeats as 0.
Null and empty texts have no tokens and are never drawn for the sample; they follow the whole repetitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions.text import strip_white
from quillstone.lineage import cut
from quillstone.llm.tokens import VOCABULARY, token_counts

#: Hash buckets of a source within which the sampled documents are ordered.
BUCKETS = 1024


def source_name(x: Column | str) -> Column:
    name = F.lower(strip_white(x))
    return F.nullif(F.regexp_replace(name, r"(?U)[\s_-]+", "_"), F.lit(""))


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source and tokens of every document with a source."""
    named = documents.select("doc_id", source_name("source").alias("source"), "text").filter("source is not null")
    counted = token_counts(named, "text", "tokens", vocabulary)
    return counted.select("doc_id", "source", "tokens")


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: what it has, what it should and what it can give, in tokens.

    Columns source, weight, max_repeats, documents, tokens, share (of the target weights), wanted (share of the mix),
    capacity, short (capacity below wanted), clamped (after redistribution) and granted. The number of sources is that
    of the targets, a configuration, so the running sums over them need no more than one task.
    """
    wanted = (
        targets.select(source_name("source").alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("r"))
        .filter("source is not null")
        .groupBy("source")
        .agg(F.sum("w").alias("weight"), F.max("r").alias("max_repeats"))
    )
    have = sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("capacity") / F.nullif("weight", F.lit(0.0)), "source").rowsBetween(Window.unboundedPreceding, -1)
    known = (
        wanted.join(have, "source", "left")
        .na.fill(0, ["documents", "tokens"])
        .withColumn("share", F.col("weight") / F.sum("weight").over(every))
        .withColumn("wanted", F.col("share") * F.sum("tokens").over(every))
        .withColumn("capacity", F.col("tokens") * F.col("max_repeats"))
    )
    left = F.sum("tokens").over(every) - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The first source that is not clamped has the highest level of those.
    level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(every)
    return (
        known.withColumn("level", F.when(weight_left > 0, left / weight_left))
        .withColumn("clamped", F.coalesce(F.col("capacity") < F.col("weight") * F.col("level"), F.lit(False)))
        .withColumn("granted", F.when(F.col("clamped"), F.col("capacity")).otherwise(F.coalesce(F.col("weight") * level, F.lit(0.0))))
        .withColumn("short", F.col("capacity") < F.col("wanted"))
        .drop("level")
    )


def draw_mix(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, tokens and copies (at least 1) of every document in the mix."""
    whole = F.floor(F.col("granted") / F.nullif("tokens", F.lit(0)))
    quota = plan.select(
        "source", F.coalesce(whole, F.lit(0)).alias("whole"), (F.col("granted") - F.coalesce(whole, F.lit(0)) * F.col("tokens")).alias("rest")
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BUCKETS << 32))
    placed = sized.withColumn("place", place).withColumn("bucket", F.shiftright("place", 32).cast("int"))
    totals = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0))).join(F.broadcast(quota), "source")
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("start") + F.sum("tokens").over(within)
    extra = F.when((F.col("tokens") > 0) & (upto <= F.col("rest")), 1).otherwise(0)
    mixed = placed.join(starts, ["source", "bucket"]).withColumn("copies", (F.col("whole") + extra).cast("int"))
    return mixed.filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def mix_report(plan: DataFrame, mix: DataFrame) -> DataFrame:
    """The plan with the tokens that the mix holds of each source, and its actual share."""
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"))
    joined = plan.join(got, "source", "left").na.fill(0, ["mixed", "most_copies"])
    return joined.withColumn("actual_share", F.col("mixed") / F.nullif(F.sum("mixed").over(Window.partitionBy()), F.lit(0)))


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The plan and the mix."""
    sized = cut(sized_documents(documents, vocabulary))
    plan = cut(mix_plan(sized, targets))
    return plan, draw_mix(sized, plan, seed)
