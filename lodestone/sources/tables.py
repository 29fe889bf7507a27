"""Where corpora, queries and labelled texts come from, and where results go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.sizes import sent_if_small

TICKETS = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "title", "text", "cat", "group")] + [T.StructField("helpful", T.BooleanType())])
QUERIES = T.StructType([T.StructField("q", T.StringType()), T.StructField("gold", T.ArrayType(T.StringType())), T.StructField("difficulty", T.StringType())])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, rows: list) -> DataFrame:
    """An injected corpus; helpful may be missing."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in TICKETS) if isinstance(r, dict) else r for r in rows], TICKETS)


def eval_queries(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in QUERIES) if isinstance(r, dict) else r for r in rows], QUERIES)


def labelled(spark: SparkSession, corpus: dict[str, list[str]], labels: list[str]) -> DataFrame:
    """text, label_id: a label's texts flattened, with its position as the id."""
    rows = spark.createDataFrame([(label, texts) for label, texts in corpus.items()], "label string, texts array<string>")
    names = spark.createDataFrame(list(enumerate(labels)), "label_id int, label string")
    return rows.join(F.broadcast(names), "label").select(F.explode("texts").alias("text"), "label_id")


@dataclass(frozen=True)
class Corpus:
    """A corpus in the form that retrieval works on: doc_id, title, text, cat, grp, helpful."""

    docs: DataFrame
    texts: DataFrame | None = None  # doc_id, title and text of docs, where they can be had without a join
    some: Callable[[DataFrame], DataFrame] | None = None  # docs of some ids, where they can be picked before a join

    @property
    def plain(self) -> DataFrame:
        """doc_id, title, text."""
        return self.docs.select("doc_id", "title", "text") if self.texts is None else self.texts

    def chosen(self, ids: DataFrame) -> DataFrame:
        """docs whose doc_id is among these, which must be few."""
        return self.some(ids) if self.some else self.docs.join(F.broadcast(ids), "doc_id", "left_semi")

    @staticmethod
    def of_tickets(rows: DataFrame) -> Corpus:
        return Corpus(rows.select(F.col("id").alias("doc_id"), "title", "text", "cat", F.col("group").alias("grp"), F.coalesce("helpful", F.lit(False)).alias("helpful")))

    @staticmethod
    def of_documents(spark: SparkSession, sf_dir: str) -> Corpus:
        """documents: the first sentence is the title, lang the category, source the answer group; helpful if the
        document's quality label is 1."""
        good = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
        title = F.split_part("text", F.lit("."), F.lit(1)).alias("title")
        documents = table(spark, sf_dir, "documents")

        def made(documents: DataFrame, good: DataFrame) -> DataFrame:
            return documents.join(good, "doc_id", "left").select("doc_id", title, "text", F.col("lang").alias("cat"), F.col("source").alias("grp"), F.coalesce("good", F.lit(False)).alias("helpful"))

        def some(ids: DataFrame) -> DataFrame:
            only = lambda df: df.join(F.broadcast(ids), "doc_id", "left_semi")
            return made(only(documents), only(good))

        return Corpus(made(documents, good), documents.select("doc_id", title, "text"), some)

    def indexed_text(self) -> Column:
        return F.concat(F.coalesce("title", F.lit("")), F.lit("。"), F.coalesce("text", F.lit("")))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("q"))


def gold_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, gold: the sources of documents that hold characters 10 to 49 of the item. Items without any, and items too
    short to have such characters, are left out."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.substring("text", 10, 40).alias("part"))
    return holding(table(spark, sf_dir, "documents"), items).groupBy("qid").agg(F.sort_array(F.collect_set("source")).alias("gold"))


def _runs_of(n: int) -> Column:
    """All runs of n characters of the text."""
    return F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.substr("text", i, F.lit(n))))


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """qid, source: for each item's part (qid, part), the documents that contain it, whatever it contains and however
    many items there are. A part with a word between two spaces can only stand in texts with that word, so candidates
    come from a join on its longest one; any other part is joined with the texts' substrings of its length. Empty parts
    are left out."""
    items = items.where("part <> ''")
    words = F.split("part", " ", -1)
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2))
    keyed = items.withColumn("key", F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    texts = docs.select(F.xxhash64("text").alias("h"), "source", "text")
    said = docs.select(F.xxhash64("text").alias("h"), F.explode_outer(F.array_distinct(F.split("text", " ", -1))).alias("key"))
    near = said.join(keyed.where("key IS NOT NULL"), "key").select("h", "qid", "part")
    rest = keyed.where("key IS NULL")
    for (n,) in rest.select(F.length("part")).distinct().collect():  # at most as many as a part has characters
        windows = docs.select(F.xxhash64("text").alias("h"), F.explode_outer(F.array_distinct(_runs_of(n))).alias("part"))
        near = near.unionByName(windows.join(rest.where(F.length("part") == n).select("qid", "part"), "part").select("h", "qid", "part"))
    # Beside few candidates the texts needn't be shuffled.
    return texts.join(sent_if_small(near.distinct().persist()), "h").where(F.contains("text", "part")).select("qid", "source")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def from_body(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Request bodies to texts; error is 'bad json' or 'blank text' where a request would be refused."""
    parsed = bodies.withColumn("parsed", F.from_json(column, "text string"))
    ok = F.col("parsed").isNotNull() & F.get_json_object(column, "$").isNotNull()
    text = F.trim(F.col("parsed.text"))
    return parsed.select(column, text.alias("text"), F.when(~ok, "bad json").when(F.coalesce(text, F.lit("")) == "", "blank text").alias("error"))
