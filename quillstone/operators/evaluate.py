"""Quality of rankings against judged documents: reciprocal rank, hit rate and nDCG at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (5, 10), key: str = "doc_id") -> DataFrame:
    """query_id, rr, recall_k and ndcg_k for every query of ``relevant`` (query_id, key); queries without hits get 0.

    ``hits`` has query_id, key and place from 1. Recall is whether a relevant document is among the first k.
    """
    wanted = relevant.select("query_id", key).distinct()
    return metrics_of(hits.join(wanted, ["query_id", key], "left_semi"), wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), cuts=cuts)


def titled(hits: DataFrame, records: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``hits`` whose record has the title of the query, and query_id and n of such records, for ``metrics_of``.

    Queries are the ``records`` (row_id, key, clause_title) with a title whose row_id is divisible by 100. Records are counted
    by title, so no pair of query and relevant record is listed.
    """
    titles = records.select("row_id", key, F.lower("clause_title").alias("title"))
    asked = titles.filter("row_id % 100 = 0 and title <> ''").select(F.col("row_id").alias("query_id"), "title").distinct()
    sizes = asked.join(titles.groupBy("title").agg(F.count(F.lit(1)).alias("n")), "title").groupBy("query_id").agg(F.sum("n").alias("n"))
    return hits.join(titles.select(key, "title"), key).join(asked, ["query_id", "title"], "left_semi"), sizes


def metrics_of(found: DataFrame, sizes: DataFrame, by: tuple[str, ...] = ("query_id",), cuts: tuple[int, ...] = (5, 10)) -> DataFrame:
    """rr, recall_k and ndcg_k for every row of ``sizes`` (``by``, n relevant records), of the relevant hits ``found`` (``by``, place)."""
    gain = lambda k: F.sum(F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1)).otherwise(0.0))
    per = found.groupBy(*by).agg(F.min("place").alias("first"), *[gain(k).alias(f"dcg_{k}") for k in cuts])
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))

    def zero(c: Column) -> Column:
        return F.coalesce(c, F.lit(0.0))

    return sizes.join(per, list(by), "left").select(
        *by,
        F.round(zero(1 / F.col("first")), 6).alias("rr"),
        *[zero((F.col("first") <= k).cast("double")).alias(f"recall_{k}") for k in cuts],
        *[F.round(zero(F.col(f"dcg_{k}") / ideal(k)), 6).alias(f"ndcg_{k}") for k in cuts],
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("query_id", "profile")]
    by = ["profile"] if "profile" in metrics.columns else []
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in names])
