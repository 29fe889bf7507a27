"""Search and evaluation reports over a corpus: what the service's verbs return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize
from lodestone.operators import metrics
from lodestone.operators.retrieval import TOP, Retrieval
from lodestone.operators.sizes import settled
from lodestone.sources.tables import as_json


def search(engine: Retrieval, query: str, k: int = TOP, rerank: bool = True) -> DataFrame:
    """The results for one query, as rows. A blank query is refused."""
    if not query.strip():
        raise ValueError("the query is blank")
    spark = engine.corpus.docs.sparkSession
    return engine.search(spark.createDataFrame([(0, query.strip())], "qid int, q string"), k, rerank).orderBy("final_rank")


def answers(engine: Retrieval, queries: DataFrame, k: int = TOP, rerank: bool = True) -> DataFrame:
    """For each query (qid, q): qid, query, tokens, pool_size, results, recall_topk, changed, reranked_ids."""
    pool = engine.recall(queries).persist()
    found = engine.search(queries, k, rerank, pool)
    item = F.struct(*[F.col(c) for c in ("final_rank", "doc_id", "title", "text", "cat", "grp", "helpful", "final_score", "recall_score", "rank_delta", "covered_terms", "missed_terms")], F.map_entries("contrib").alias("contrib"))
    results = found.groupBy("qid").agg(F.sort_array(F.collect_list(item)).alias("results"), F.sort_array(F.collect_list(F.when(F.col("rank_delta") != 0, F.col("doc_id")))).alias("changed"), (F.sort_array(F.collect_list("doc_id")) if rerank else F.array().cast("array<string>")).alias("reranked_ids"))
    if rerank:
        pool = pool.join(engine.corpus.docs.select("doc_id", "title", "grp"), "doc_id")
        top = F.sort_array(F.collect_list(F.when(F.col("recall_rank") <= k, F.struct("recall_rank", "doc_id", "title", "grp", "recall_score"))))
    else:
        top = F.array()
    pool = pool.groupBy("qid").agg(F.count(F.lit(1)).alias("pool_size"), top.alias("recall_topk"))
    rows = queries.join(pool, "qid", "left").join(results, "qid", "left")
    return rows.select("qid", F.col("q").alias("query"), tokenize("q").alias("tokens"), "pool_size", "results", "recall_topk", "changed", "reranked_ids")


def search_json(engine: Retrieval, query: str, k: int = TOP, rerank: bool = True) -> DataFrame:
    """One JSON text: query, tokens, pool_size, results, recall_topk, changed, reranked_ids."""
    if not query.strip():
        raise ValueError("the query is blank")
    asked = engine.corpus.docs.sparkSession.createDataFrame([(0, query.strip())], "qid int, q string")
    return as_json(answers(engine, asked, k, rerank).drop("qid"))


class Evaluation:
    """Recall alone against recall with rerank, for queries (qid, q) with gold (qid, gold). By default the baseline
    list is the whole pool and the reranked one is cut at top_k; same_cut cuts both."""

    def __init__(self, engine: Retrieval, queries: DataFrame, gold: DataFrame, top_k: int = TOP, same_cut: bool = False):
        self.gold = gold
        queries = queries.join(gold.select("qid"), "qid", "left_semi")
        # Both arms come from one pool, which is kept: ten rows a query.
        features = settled(engine.features(queries))
        base = features.select("qid", F.col("recall_rank").alias("rank"), "grp", "title", "doc_id")
        self.baseline = base.where(F.col("rank") <= top_k) if same_cut else base
        self.reranked = engine.reranked(features, top_k).select("qid", F.col("final_rank").alias("rank"), "grp", "title", "doc_id")

    def metrics(self, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
        one = lambda df, arm: metrics.evaluate(df, self.gold, ks).withColumn("arm", F.lit(arm))
        return one(self.baseline, "baseline").unionByName(one(self.reranked, "rerank"))

    def per_query(self) -> DataFrame:
        return metrics.compared(self.baseline, self.reranked, self.gold)

    def flips(self) -> DataFrame:
        return metrics.flips(self.per_query())

    def failed(self) -> DataFrame:
        return self.per_query().where("NOT top1_hit").select("qid")


def strategies(engine: Retrieval, queries: DataFrame, gold: DataFrame, k: int = TOP, ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """Similarity alone, rank fusion and rerank, each cut at k: one row of metrics each."""
    queries = queries.join(gold.select("qid"), "qid", "left_semi")
    pool = settled(engine.features(queries))
    by_sim = pool.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_id"))).where(F.col("rank") <= k)
    lists = {"sim": by_sim, "rrf": engine.fuse(pool, k).withColumnRenamed("rrf_rank", "rank"), "rerank": engine.reranked(pool, k).withColumnRenamed("final_rank", "rank")}
    lists = {n: df.select("qid", "doc_id", "rank", "grp") for n, df in lists.items()}
    out = None
    for name, df in lists.items():
        row = metrics.evaluate(df, gold, ks).withColumn("strategy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
