"""One query per operator over the shared test tables: documents are the corpus, benchmark items the queries, lang
the label of texts."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.numbers import dot, l2_normalize, rounded, wilson
from lodestone.operators import augment, intent, metrics, train
from lodestone.operators.index import Index, tfidf_weight
from lodestone.operators.retrieval import Retrieval, nearest
from lodestone.operators.sizes import settled
from lodestone.plans.intent import cross_validate, featured, grid_search
from lodestone.plans.retrieval import Evaluation, answers, strategies
from lodestone.sources import tables

#: The test tables hold no Chinese; these markers turn up in them.
MARKERS = (" of ", " und ", " de ", " the ")
SYNONYMS = (("the", "that"), ("und", "sowie"), ("que", "cual"), ("des", "du"))
LABELS = ("de", "en", "es", "fr")
MIN_DF = 5
_engines: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def engine(spark: SparkSession, sf_dir: str) -> Retrieval:
    """One index to a session, that of the last folder, as a service would hold it."""
    held = _engines.setdefault(spark, {})
    if sf_dir not in held:
        while held:
            held.popitem()[1].release()
        held[sf_dir] = Retrieval(tables.Corpus.of_documents(spark, sf_dir), markers=MARKERS)
    return held[sf_dir]


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.benchmark_queries(spark, sf_dir)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LABELS)), "label_id int, label string")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).join(F.broadcast(labels(spark)), F.col("lang") == F.col("label"))
    return rows.select("doc_id", "text", "label_id")


def train_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).where("doc_id % 5 <> 0")


def test_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).where("doc_id % 5 = 0")


def _joined(column):
    return F.array_join(column, " ")


def tokenize(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.tokenize("text").alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(_joined("ts")).alias("tokens_md5"))


def char_ngrams(spark, sf_dir):
    rows = asked(spark, sf_dir).select("qid", T.char_ngrams("q").alias("g2"), T.char_ngrams("q", 3).alias("g3"))
    return rows.select("qid", F.size("g2").cast("long").alias("n2"), F.md5(_joined("g2")).alias("g2_md5"), F.md5(_joined("g3")).alias("g3_md5"))


def token_counts(spark, sf_dir):
    return engine(spark, sf_dir).index.counts.select("doc_id", "t", "n", "wn")


def doc_freq_idf(spark, sf_dir):
    return engine(spark, sf_dir).index.vocab.select("t", "df", rounded(F.col("idf"), 6).alias("idf"))


def bm25_idf(spark, sf_dir):
    return engine(spark, sf_dir).index.vocab.where("wdf > 0").select("t", "wdf", rounded(F.col("bidf"), 6).alias("bidf"))


def tfidf_weights(spark, sf_dir):
    rows = engine(spark, sf_dir).query_tokens(asked(spark, sf_dir))
    return rows.where("qw IS NOT NULL").select("qid", "t", rounded(F.col("qw"), 6).alias("w"))


def tfidf_norms(spark, sf_dir):
    return engine(spark, sf_dir).index.docs.select("doc_id", "dl", rounded(F.col("norm"), 4).alias("norm"))


def vocabulary_min_df(spark, sf_dir):
    rows = tables.Corpus.of_documents(spark, sf_dir)
    index = Index.of(rows.docs, rows.indexed_text(), char_ngram=False, min_df=MIN_DF)
    kept = index.vocab.where("idf IS NOT NULL")
    return kept.select("t", "df", (F.row_number().over(Window.orderBy("t")) - 1).cast("long").alias("place"))


def cosine_topk(spark, sf_dir):
    rows = engine(spark, sf_dir).recall(asked(spark, sf_dir))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_id"))).where("rank <= 5").select("qid", "doc_id", "sim", F.col("rank").cast("long").alias("rank"))


def bm25_scores(spark, sf_dir):
    e, q = engine(spark, sf_dir), asked(spark, sf_dir)
    return e.matches(q, e.query_tokens(q)).select("qid", "doc_id", "bm25_raw", "bm25", "sim")


def recall_pool(spark, sf_dir):
    return engine(spark, sf_dir).recall(asked(spark, sf_dir)).select("qid", "doc_id", F.col("recall_rank").cast("long").alias("recall_rank"), "recall_score", "sim", "bm25", "bm25_raw")


def features(spark, sf_dir):
    rows = engine(spark, sf_dir).features(asked(spark, sf_dir))
    return rows.select("qid", "doc_id", "sim", "bm25", "coverage", F.col("title_cover"), "gram_overlap", F.col("title_hit"), "cat_hit", "helpful_hit", "clause")


def covered_missed_terms(spark, sf_dir):
    rows = engine(spark, sf_dir).features(asked(spark, sf_dir))
    return rows.select("qid", "doc_id", _joined("covered_terms").alias("covered"), _joined("missed_terms").alias("missed"))


def contrast_split(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", T.contrast("q", MARKERS).alias("c")).select("qid", "c.head", "c.tail")


def rerank_topk(spark, sf_dir):
    rows = engine(spark, sf_dir).rerank(asked(spark, sf_dir))
    return rows.select("qid", "doc_id", "grp", F.col("final_rank").cast("long").alias("final_rank"), "final_score", "recall_score", F.col("dup_count").cast("long").alias("dup_count"), F.col("rank_delta").cast("long").alias("rank_delta"))


def contrib(spark, sf_dir):
    rows = engine(spark, sf_dir).rerank(asked(spark, sf_dir))
    return rows.select("qid", "doc_id", *[F.col("contrib")[k].alias(f"c_{k}") for k in ("sim", "bm25", "coverage", "title", "cat", "helpful", "clause")])


def recall_only(spark, sf_dir):
    rows = engine(spark, sf_dir).search(asked(spark, sf_dir), 5, use_rerank=False)
    return rows.select("qid", "doc_id", "final_score", F.col("final_rank").cast("long").alias("final_rank"), F.col("rank_delta").cast("long").alias("rank_delta"), F.size("contrib").cast("long").alias("n_contrib"))


def rrf_fusion(spark, sf_dir):
    return engine(spark, sf_dir).fused(asked(spark, sf_dir)).select("qid", "doc_id", "rrf", F.col("rrf_rank").cast("long").alias("rrf_rank"))


def _gold(spark, sf_dir) -> DataFrame:
    """Kept, since evaluations look at it several times: a row for each item at most."""
    return settled(tables.gold_groups(spark, sf_dir))


def _evaluation(spark, sf_dir) -> Evaluation:
    return Evaluation(engine(spark, sf_dir), asked(spark, sf_dir), _gold(spark, sf_dir))


def gold_groups(spark, sf_dir):
    return tables.gold_groups(spark, sf_dir).select("qid", _joined("gold").alias("gold"))


def hit_flags(spark, sf_dir):
    e = _evaluation(spark, sf_dir)
    return metrics.hits(e.baseline, e.gold).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"), "hit", "new")


def query_metrics(spark, sf_dir):
    e = _evaluation(spark, sf_dir)
    return metrics.per_query(e.reranked, e.gold, (1, 3, 5)).withColumn("first_hit", F.col("first_hit").cast("long"))


def eval_summary(spark, sf_dir):
    return _evaluation(spark, sf_dir).metrics()


def rank_flips(spark, sf_dir):
    return _evaluation(spark, sf_dir).flips()


def per_query_report(spark, sf_dir):
    rows = _evaluation(spark, sf_dir).per_query()
    return rows.select("qid", _joined("gold").alias("gold"), "top1", "top1_hit", "baseline_top1", "baseline_top1_hit", F.col("rank_of_gold").cast("long").alias("rank_of_gold"))


def failed_queries(spark, sf_dir):
    return _evaluation(spark, sf_dir).failed()


def three_strategies(spark, sf_dir):
    return strategies(engine(spark, sf_dir), asked(spark, sf_dir), _gold(spark, sf_dir))


def _keywords(spark, sf_dir) -> intent.Keywords:
    return intent.Keywords.fit(train_part(spark, sf_dir), labels(spark))


def keyword_table(spark, sf_dir):
    return _keywords(spark, sf_dir).table.select("label_id", "t", rounded(F.col("idf"), 6).alias("idf"), F.col("place").cast("long").alias("place"))


def keyword_scores(spark, sf_dir):
    return _keywords(spark, sf_dir).scores(examples(spark, sf_dir))


def keyword_proba(spark, sf_dir):
    rows = _keywords(spark, sf_dir).probabilities(examples(spark, sf_dir))
    return rows.select("doc_id", "label_id", rounded(F.col("p"), 6).alias("p"))


def _predicted(spark, sf_dir) -> DataFrame:
    model = _keywords(spark, sf_dir)
    return intent.predictions(model.probabilities(examples(spark, sf_dir)), model.labels)


def _judged(spark, sf_dir) -> DataFrame:
    return _predicted(spark, sf_dir).join(test_part(spark, sf_dir).select("doc_id", "label_id"), "doc_id")


def keyword_predict(spark, sf_dir):
    rows = _predicted(spark, sf_dir)
    return rows.select("doc_id", "pred", "label", "confidence", "margin", F.array_join(F.transform("top3", lambda x: x["label"]), " ").alias("top3"))


def action_policy(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text")
    model = _keywords(spark, sf_dir)
    found = intent.predictions(model.probabilities(rows), model.labels)
    return found.select("doc_id", "label", "confidence", "margin", intent.action(F.col("confidence"), F.col("margin")).alias("action"))


def class_report(spark, sf_dir):
    return intent.class_report(_judged(spark, sf_dir), labels(spark)).drop("raw_f1")


def report_summary(spark, sf_dir):
    return intent.summary(_judged(spark, sf_dir), labels(spark))


def confusion_matrix(spark, sf_dir):
    return intent.confusion(_judged(spark, sf_dir), labels(spark))


def wilson_ci(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "labels").join(documents(spark, sf_dir), "doc_id").groupBy("source").agg(F.sum(F.col("quality").cast("long")).alias("success"), F.count(F.lit(1)).alias("total"))
    return rows.select("source", "success", "total", wilson(F.col("success"), F.col("total")).alias("ci")).select("source", "success", "total", "ci.low", "ci.high")


def kfold_assign(spark, sf_dir):
    return intent.folds(examples(spark, sf_dir)).select("doc_id", "label_id", F.col("fold").cast("long").alias("fold"))


def augment_synonyms(spark, sf_dir):
    rows = augment.augment(examples(spark, sf_dir), synonyms=SYNONYMS)
    return rows.select("doc_id", "pass", "label_id", F.md5("text").alias("text_md5"))


def train_test_overlap(spark, sf_dir):
    same = train_part(spark, sf_dir).select("text").intersect(test_part(spark, sf_dir).select("text"))
    ids = documents(spark, sf_dir).agg(F.count("doc_id").alias("n_ids"), F.count_distinct("doc_id").alias("n_distinct"))
    return same.agg(F.count(F.lit(1)).alias("n_shared_texts")).crossJoin(ids)


def token_f1(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokenize("text").alias("a"))
    other = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(other, ["conv_id", "turn"]).select("conv_id", "turn", rounded(T.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


def dense_cosine_knn(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"), 5).select("query_id", "vec_id", "cosine", F.col("rank").cast("long").alias("rank"))


def dense_normalize(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    return rows.select("vec_id", rounded(dot(F.col("v"), F.col("v")), 6).alias("length"), rounded(F.col("v")[0], 5).alias("first"), F.size("v").cast("long").alias("dim"))


def _unit_vectors(spark, sf_dir) -> DataFrame:
    """TF-IDF over words of the training part, without rare ones, as unit vectors of all examples."""
    fit = train_part(spark, sf_dir)
    index = Index.of(fit, F.col("text"), char_ngram=False, min_df=MIN_DF)
    from lodestone.operators.index import token_counts as counted

    rows = counted(examples(spark, sf_dir), "doc_id", F.col("text"), char_ngram=False).join(index.vocab.where("idf IS NOT NULL").select("t", "idf"), "t")
    rows = rows.withColumn("raw", tfidf_weight(F.col("n"), F.col("idf")))
    norm = rows.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return rows.join(norm, "doc_id").select("doc_id", "t", (F.col("raw") / F.when(F.col("norm") <= 1e-12, 1.0).otherwise(F.col("norm"))).alias("x"))


def linear_scores(spark, sf_dir):
    """A linear model whose weights are the keyword table's, on unit vectors, with softmax."""
    weights = F.broadcast(_keywords(spark, sf_dir).table.select("label_id", "t", F.col("idf").alias("w")))
    x = _unit_vectors(spark, sf_dir)
    z = x.join(weights, "t").groupBy("doc_id", "label_id").agg(F.sum(F.col("x") * F.col("w")).alias("z"))
    rows = examples(spark, sf_dir).select("doc_id").crossJoin(F.broadcast(labels(spark).select("label_id"))).join(z, ["doc_id", "label_id"], "left").na.fill(0.0, ["z"])
    by = Window.partitionBy("doc_id")
    e = F.exp(F.col("z") - F.max("z").over(by))
    return rows.select("doc_id", "label_id", rounded(F.col("z"), 6).alias("z"), e.alias("e")).select("doc_id", "label_id", "z", rounded(F.col("e") / F.sum("e").over(by), 6).alias("p"))


def logreg_first_step(spark, sf_dir):
    """The gradient of softmax regression at zero weights over the whole training part."""
    fit = train_part(spark, sf_dir)
    x = _unit_vectors(spark, sf_dir).join(fit.select("doc_id", F.col("label_id").alias("y")), "doc_id")
    n = fit.agg(F.count(F.lit(1)).alias("n_docs"))
    sums = x.groupBy("t").agg(F.sum("x").alias("every"), *[F.coalesce(F.sum(F.when(F.col("y") == k, F.col("x"))), F.lit(0.0)).alias(f"own_{k}") for k in range(len(LABELS))])
    rows = sums.crossJoin(F.broadcast(n))
    return rows.select("t", *[rounded((F.col("every") / len(LABELS) - F.col(f"own_{k}")) / F.col("n_docs"), 8).alias(f"g_{k}") for k in range(len(LABELS))])


def corpus_dump(spark, sf_dir):
    return tables.Corpus.of_documents(spark, sf_dir).docs.select("doc_id", "title", F.md5("text").alias("text_md5"), "cat", "grp", "helpful")


def health(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.agg(F.count(F.lit(1)).alias("tickets"), F.count_distinct("lang").alias("labels")).withColumn("status", F.lit("ok"))


def json_results(spark, sf_dir):
    rows = engine(spark, sf_dir).rerank(asked(spark, sf_dir), 1).select("qid", "doc_id", "cat", "grp")
    return tables.as_json(rows)


def search_answer(spark, sf_dir):
    """What a search answers, for every item: ids of the results, of what moved, and of the best before the rerank."""
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["doc_id"].cast("string")), " ")
    rows = answers(engine(spark, sf_dir), asked(spark, sf_dir))
    return rows.select("qid", F.size("tokens").cast("long").alias("n_tokens"), "pool_size", ids("results").alias("results"), F.array_join(F.transform("changed", lambda x: x.cast("string")), " ").alias("changed"), ids("recall_topk").alias("recall_topk"))


def document_vectors(spark, sf_dir):
    return engine(spark, sf_dir).index.weights().select("doc_id", "t", rounded(F.col("w"), 6).alias("w"))


def request_bodies(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select("event_id", "event_type")
    bodies = rows.select("event_id", F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("text")))).when(F.col("event_id") % 3 == 1, F.lit('{"text": "  "}')).otherwise(F.lit("{oops")).alias("body"))
    found = tables.from_body(bodies.select("event_id", "body").withColumnRenamed("event_id", "_id"))
    counts = found.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts


#: Labelled rows that the parity trainers are fitted on at most; a run is the work of one task.
SAMPLE = 200


def _sample(spark, sf_dir) -> DataFrame:
    """A bounded sample of the training part: the SAMPLE examples whose ids hash lowest, with their whole texts."""
    return train_part(spark, sf_dir).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE)


def _trained(spark, sf_dir, hidden: int) -> DataFrame:
    """Fitted on the sample, scored on every document."""
    rows = featured(_sample(spark, sf_dir)).select("doc_id", "tokens", "label_id").orderBy("doc_id").collect()
    vectorize = train.Vectorizer([r["tokens"] for r in rows])
    x, y = vectorize([r["tokens"] for r in rows]), train.np.array([r["label_id"] for r in rows], int)
    net = train.Net(x.shape[1], len(LABELS), hidden=hidden, epochs=80 if hidden else 100).fit(x, y)
    found = intent.predictions(train.batches(featured(examples(spark, sf_dir)), net, vectorize), labels(spark))
    return found.select("doc_id", "pred", "label", "confidence", "margin")


def logreg_train(spark, sf_dir):
    return _trained(spark, sf_dir, 0)


def mlp_train(spark, sf_dir):
    return _trained(spark, sf_dir, 16)


def cross_validation(spark, sf_dir):
    """Folds over the whole training part; each fit takes SAMPLE rows of the other folds."""
    return cross_validate(train_part(spark, sf_dir), len(LABELS), sample=SAMPLE)


def tuning_grid(spark, sf_dir):
    return grid_search(train_part(spark, sf_dir), test_part(spark, sf_dir), len(LABELS), sample=SAMPLE)


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, char_ngrams, token_counts, doc_freq_idf, bm25_idf, tfidf_weights, tfidf_norms, vocabulary_min_df, cosine_topk, bm25_scores, recall_pool, features,
        covered_missed_terms, contrast_split, rerank_topk, contrib, recall_only, rrf_fusion, gold_groups, hit_flags, query_metrics, eval_summary, rank_flips,
        per_query_report, failed_queries, three_strategies, keyword_table, keyword_scores, keyword_proba, keyword_predict, action_policy, class_report, report_summary,
        confusion_matrix, wilson_ci, kfold_assign, augment_synonyms, train_test_overlap, token_f1, dense_cosine_knn, dense_normalize, linear_scores, logreg_first_step,
        corpus_dump, health, json_results, search_answer, document_vectors, request_bodies, logreg_train, mlp_train, cross_validation, tuning_grid,
    )
}
