"""Ranking metrics by answer group. ranked: qid, rank, grp; gold: qid, gold (array of groups)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import rounded, share


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked with hit, and new for the first result of each gold group."""
    rows = ranked.join(gold, "qid").withColumn("hit", F.coalesce(F.array_contains("gold", F.col("grp")), F.lit(False)))
    turn = F.row_number().over(Window.partitionBy("qid", "grp").orderBy("rank"))
    return rows.withColumn("new", F.col("hit") & (turn == 1))


def per_query(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """qid, recall_k and ndcg_k for each k, mrr, first_hit. A query without results scores 0."""
    rows = gold.join(hits(ranked, gold).drop("gold"), "qid", "left")
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    found = rows.groupBy("qid").agg(
        F.first("gold").alias("gold"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"),
        *[F.coalesce(F.sum(F.when(F.col("new") & (F.col("rank") <= k), gain)), F.lit(0.0)).alias(f"dcg_{k}") for k in ks],
    )
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size("gold"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    reach = lambda k: F.when(F.size("gold") == 0, 0.0).otherwise(ideal(k))
    out = {}
    for k in ks:
        out[f"recall_{k}"] = F.coalesce((F.col("first_hit") <= k).cast("double"), F.lit(0.0))
        out[f"ndcg_{k}"] = rounded(share(F.col(f"dcg_{k}"), reach(k)), 6)
    mrr = F.coalesce(rounded(1.0 / F.col("first_hit"), 6), F.lit(0.0))
    return found.select("qid", *[v.alias(n) for n, v in out.items()], mrr.alias("mrr"), "first_hit")


def evaluate(ranked: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """One row: n_queries and the means."""
    rows = per_query(ranked, gold, ks)
    names = [f"{m}_{k}" for k in ks for m in ("recall", "ndcg")] + ["mrr"]
    return rows.agg(F.count(F.lit(1)).alias("n_queries"), *[F.coalesce(rounded(F.avg(n)), F.lit(0.0)).alias(n) for n in names])


def compared(baseline: DataFrame, reranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: the first result of both rankings (with title), whether it hits, where reranked first hits, and
    whether the first title changed."""
    top = lambda df, p: hits(df, gold).where("rank = 1").select("qid", F.col("title").alias(f"{p}top1"), F.col("hit").alias(f"{p}top1_hit"))
    first = per_query(reranked, gold, (1,)).select("qid", F.col("first_hit").alias("rank_of_gold"))
    rows = gold.select("qid", "gold").join(top(reranked, ""), "qid", "left").join(top(baseline, "baseline_"), "qid", "left").join(first, "qid", "left")
    for p in ("", "baseline_"):
        rows = rows.withColumns({f"{p}top1": F.coalesce(f"{p}top1", F.lit("")), f"{p}top1_hit": F.coalesce(f"{p}top1_hit", F.lit(False))})
    return rows.withColumn("changed", F.col("top1") != F.col("baseline_top1"))


def flips(rows: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    changed, now, before = F.col("changed"), F.col("top1_hit"), F.col("baseline_top1_hit")
    return rows.agg(count(changed).alias("n"), count(changed & now & ~before).alias("improved"), count(changed & before & ~now).alias("worsened"), count(~changed).alias("unchanged"))
