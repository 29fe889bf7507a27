"""Intent classification: keyword scores, linear scores, policy, and reports.

examples: doc_id, label_id and text. Labels are a small ordered table: label_id, label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import rounded, share, wilson
from lodestone.functions.text import tokenize
from lodestone.operators.index import tfidf_idf

TOP_PER_CLASS = 12
# Confidence and margin from which an answer goes out by itself, and confidence from which it is proposed.
AUTO, AUTO_MARGIN, ASSIST = 0.7, 0.35, 0.45


def token_sets(texts: DataFrame, *keys: str) -> DataFrame:
    """keys and t: the distinct word tokens of each text."""
    rows = texts.select(*keys, F.array_distinct(tokenize("text")).alias("ts"))
    return rows.select(*keys, F.explode_outer("ts").alias("t")).where("t IS NOT NULL")


@dataclass
class Keywords:
    """Per class, the tokens with the greatest document count times idf; ties go to the token first in order."""

    table: DataFrame  # label_id, t, idf, weight, place
    labels: DataFrame  # label_id, label

    @staticmethod
    def fit(examples: DataFrame, labels: DataFrame, top_per_class: int = TOP_PER_CLASS) -> Keywords:
        counts = token_sets(examples, "doc_id", "label_id").groupBy("label_id", "t").agg(F.count(F.lit(1)).alias("n"))
        df = counts.groupBy("t").agg(F.sum("n").alias("df"))
        n = examples.agg(F.count(F.lit(1)).alias("n_docs"))
        idf = df.crossJoin(F.broadcast(n)).select("t", tfidf_idf(F.col("n_docs"), F.col("df")).alias("idf"))
        rows = counts.join(idf, "t").withColumn("weight", F.col("n") * F.col("idf"))
        place = F.row_number().over(Window.partitionBy("label_id").orderBy(F.desc("weight"), "t"))
        return Keywords(rows.withColumn("place", place).where(F.col("place") <= top_per_class).select("label_id", "t", "idf", "weight", "place"), labels)

    def scores(self, texts: DataFrame) -> DataFrame:
        """doc_id, label_id, score for every text and label; 0 without a hit."""
        said = token_sets(texts, "doc_id").join(F.broadcast(self.table.select("label_id", "t", "idf")), "t")
        hit = said.groupBy("doc_id", "label_id").agg(F.sum("idf").alias("score"))
        every = texts.select("doc_id").crossJoin(F.broadcast(self.labels.select("label_id")))
        return every.join(hit, ["doc_id", "label_id"], "left").select("doc_id", "label_id", rounded(F.coalesce("score", F.lit(0.0)), 6).alias("score"))

    def probabilities(self, texts: DataFrame) -> DataFrame:
        """doc_id, label_id, p: softmax of the scores over their greatest. Nothing hit: all the same."""
        by = Window.partitionBy("doc_id")
        rows = self.scores(texts).withColumn("top", F.max("score").over(by))
        top = F.when(F.col("top") == 0, 1.0).otherwise(F.col("top"))
        rows = rows.withColumn("e", F.exp((F.col("score") - top) / F.greatest(top, F.lit(1e-6))))
        return rows.select("doc_id", "label_id", (F.col("e") / F.sum("e").over(by)).alias("p"))


def predictions(probabilities: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, pred, label, confidence, margin, top3; the first label wins a tie."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("p"), "label_id")
    rows = probabilities.withColumn("p", F.col("p")).withColumn("r", F.row_number().over(order)).where("r <= 3").join(F.broadcast(labels), "label_id")
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    top3 = F.transform(F.sort_array(F.collect_list(F.struct("r", "label", F.col("p")))), lambda x: F.struct(x["label"].alias("label"), rounded(x["p"]).alias("p")))
    return rows.groupBy("doc_id").agg(at(1, "label_id").alias("pred"), at(1, "label").alias("label"), rounded(at(1, "p")).alias("confidence"), rounded(at(1, "p") - F.coalesce(at(2, "p"), F.lit(0.0))).alias("margin"), top3.alias("top3"))


def action(confidence: Column, margin: Column) -> Column:
    """What to do with an answer, on rounded values."""
    return F.when((confidence >= AUTO) & (margin >= AUTO_MARGIN), "auto").when(confidence >= ASSIST, "assist").otherwise("human")


def class_report(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """judged: pred, label_id (the truth). Per label: precision, recall, f1, support; labels nobody has are there."""
    truth = judged.groupBy("label_id").agg(F.count(F.lit(1)).alias("support"), F.sum((F.col("pred") == F.col("label_id")).cast("long")).alias("tp"))
    said = judged.groupBy(F.col("pred").alias("label_id")).agg(F.count(F.lit(1)).alias("said"))
    rows = labels.join(truth, "label_id", "left").join(said, "label_id", "left").na.fill(0, ["support", "tp", "said"])
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    rows = rows.withColumns({"p": p, "r": r})
    f1 = share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return rows.select("label_id", "label", rounded(F.col("p")).alias("precision"), rounded(F.col("r")).alias("recall"), rounded(f1).alias("f1"), f1.alias("raw_f1"), "support")


def summary(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n, accuracy, its interval, macro_f1 over all labels, mean_confidence."""
    right = F.coalesce(F.sum((F.col("pred") == F.col("label_id")).cast("long")), F.lit(0))
    confidence = F.avg("confidence") if "confidence" in judged.columns else F.lit(None).cast("double")
    all_ = judged.agg(F.count(F.lit(1)).alias("n"), right.alias("right"), rounded(confidence).alias("mean_confidence"))
    macro = class_report(judged, labels).agg(rounded(F.avg("raw_f1")).alias("macro_f1"))
    rows = all_.crossJoin(macro).withColumn("ci", wilson(F.col("right"), F.col("n")))
    return rows.select("n", rounded(F.col("right") / F.greatest("n", F.lit(1))).alias("accuracy"), F.col("ci.low").alias("ci_low"), F.col("ci.high").alias("ci_high"), "macro_f1", "mean_confidence")


def confusion(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """truth, predicted, n for every pair of labels."""
    pairs = labels.select(F.col("label_id").alias("truth")).crossJoin(labels.select(F.col("label_id").alias("predicted")))
    counts = judged.groupBy(F.col("label_id").alias("truth"), F.col("pred").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(counts, ["truth", "predicted"], "left").na.fill(0, ["n"])


def folds(examples: DataFrame, k: int = 4, seed: int = 3) -> DataFrame:
    """doc_id, label_id, fold: within each class, dealt in turn in an order that hashes give."""
    if k < 2:
        raise ValueError("k must be at least 2")
    order = Window.partitionBy("label_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), "doc_id")
    return examples.select("doc_id", "label_id", ((F.row_number().over(order) - 1) % k).alias("fold"))
