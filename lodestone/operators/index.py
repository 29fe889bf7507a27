"""TF-IDF and BM25 statistics of a corpus as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import char_ngrams, tokenize
from lodestone.operators import postings
from lodestone.operators.sizes import BYTES, ROWS

K1, B = 1.5, 0.75
#: Documents of a partition of the index, so that its postings are counted in memory.
PARTITION = 2_000
#: Tokens of several documents of which hashes and df may go to all tasks, 12 bytes each.
KNOWN = 8_000_000


def token_counts(texts: DataFrame, key: str, text: Column, char_ngram: bool = True) -> DataFrame:
    """key, t, n (occurrences among words and character pairs together), wn (among words alone).

    The arrays are made in a stage of their own and unfolded with explode_outer: a plain explode would have the
    optimizer evaluate them twice. A document's rows are counted where they are made, before any shuffle."""
    words = texts.select(F.col(key), tokenize(text).alias("w"), (char_ngrams(text) if char_ngram else F.array().cast("array<string>")).alias("g"))
    rows = words.select(key, F.posexplode_outer(F.concat("w", "g")).alias("pos", "t"), F.size("w").alias("k")).where("t IS NOT NULL")
    return rows.groupBy(key, "t").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pos") < F.col("k")).cast("long")).alias("wn"))


def tfidf_idf(n_docs: Column, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def tfidf_weight(n: Column, idf: Column) -> Column:
    return (1.0 + F.log(n.cast("double"))) * idf


def bm25_part(qn: Column, idf: Column, n: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """What a query token, said qn times, adds to a document's score."""
    dl = F.when(length == 0, 1).otherwise(length)
    return qn * idf * (n * (k1 + 1)) / (n + k1 * (1 - b + b * dl / average))


def frequencies(counts: DataFrame) -> DataFrame:
    """t, df, wdf: in how many documents a token is, and in how many as a word."""
    return counts.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum((F.col("wn") > 0).cast("long")).alias("wdf"))


def vocabulary(found: DataFrame, n_docs: DataFrame, min_df: int = 1) -> DataFrame:
    """t, df, idf, wdf, bidf of frequencies. n_docs: one row, n_docs. A token of too few documents has no idf; one that
    is no word anywhere has no bidf."""
    rows = found.crossJoin(F.broadcast(n_docs))
    return rows.select("t", "df", F.when(F.col("df") >= min_df, tfidf_idf(F.col("n_docs"), F.col("df"))).alias("idf"), "wdf", F.when(F.col("wdf") > 0, bm25_idf(F.col("n_docs"), F.col("wdf"))).alias("bidf"))


def _common(found: DataFrame) -> int:
    """The least df from which on tokens are few enough to be broadcast; 1 if all are."""
    steps = [F.struct(F.count(F.when(F.col("df") >= 1 << i, 1)), F.coalesce(F.sum(F.when(F.col("df") >= 1 << i, F.octet_length("t") + 16)), F.lit(0))) for i in range(48)]
    return next(1 << i for i, (rows, size) in enumerate(found.agg(*steps).first()) if rows <= ROWS and size <= BYTES)


def statistics(counts: DataFrame, found: DataFrame, vocab: DataFrame, partitions: int) -> DataFrame:
    """doc_id, dl, norm. Common tokens are looked up where postings lie, so that a document is one row; only postings
    of tokens that are too many to be broadcast, each in few documents, are shuffled."""
    square = lambda n, idf: tfidf_weight(F.col(n), F.col(idf)) ** 2
    least = _common(found)
    weighed = counts.join(F.broadcast(vocab.where(F.col("df") >= least).select("t", "idf", "df")), "t", "left")
    if least > 1:
        # A document's row of common tokens has a key that is no token: tokens have no spaces.
        rare = F.when(F.col("df").isNull(), F.col("t"))
        rows = weighed.groupBy("doc_id", rare.alias("rare"), F.when(F.col("df").isNull(), F.col("n")).alias("rn")).agg(F.sum("wn").alias("wn"), F.sum(square("n", "idf")).alias("sq"))
        rows = rows.select("doc_id", "rn", "wn", "sq", F.coalesce("rare", F.concat(F.lit(" "), F.col("doc_id").cast("string"))).alias("t"))
        rows = rows.join(vocab.where(F.col("df") < least).select("t", "idf"), "t", "left").repartition(partitions, "doc_id")
        return rows.groupBy("doc_id").agg(F.sum("wn").alias("dl"), F.sqrt(F.sum(F.coalesce("sq", square("rn", "idf")))).alias("norm"))
    return weighed.groupBy("doc_id").agg(F.sum("wn").alias("dl"), F.sqrt(F.sum(square("n", "idf"))).alias("norm"))


@dataclass
class Index:
    """The statistics that scoring needs, kept for as long as the session uses them. Postings are counted from the texts
    wherever they are needed: on disk they would take several times the input. Rows of them, for those who ask for
    them, are kept in memory as far as it goes."""

    rows: DataFrame  # doc_id, rows: the texts, as operators.postings takes them
    char_ngram: bool
    min_df: int
    counts: DataFrame  # doc_id, t, n, wn
    vocab: DataFrame  # t, df, idf, wdf, bidf
    totals: DataFrame  # one row: n_docs, avg_len
    partitions: int  # by doc_id, of counts
    n_docs: int
    found: DataFrame  # t, df, wdf, said: what vocab is made of
    _average: list[float] = field(default_factory=list)
    _made: dict = field(default_factory=dict)

    @staticmethod
    def of(texts: DataFrame, text: Column, char_ngram: bool = True, min_df: int = 1) -> Index:
        ids = texts.select("doc_id", text.alias("_body"))
        n, with_id, distinct = texts.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
        partitions = max(ids.sparkSession.sparkContext.defaultParallelism, -(-n // PARTITION))
        counts = token_counts(ids.repartition(partitions, "doc_id"), "doc_id", F.col("_body"), char_ngram).persist(StorageLevel.MEMORY_ONLY)
        n_docs = ids.sparkSession.createDataFrame([(n,)], "n_docs long")
        rows = postings.packed(texts, text, with_id == distinct and n - with_id <= 1)
        found = postings.frequencies(rows, char_ngram).persist()
        vocab = vocabulary(found, n_docs, min_df)
        # A text of separators alone has no token but counts in the average.
        words = found.agg(F.coalesce(F.sum("said"), F.lit(0)).alias("words"))
        totals = n_docs.crossJoin(words).select("n_docs", F.when((F.col("n_docs") > 0) & (F.col("words") > 0), F.col("words") / F.col("n_docs")).otherwise(1.0).alias("avg_len"))
        return Index(rows, char_ngram, min_df, counts, vocab, totals, partitions, n, found)

    @property
    def known(self) -> tuple | None:
        """Hashes and df of the tokens of several documents; None if they are too many to be sent to all tasks."""
        if "known" not in self._made:
            self._made["known"] = postings.table(self.found, KNOWN)
        return self._made["known"]

    @property
    def docs(self) -> DataFrame:
        """doc_id, dl, norm: one row per document that has tokens."""
        if "docs" not in self._made:
            if self.known:
                docs = postings.documents(self.rows, self.char_ngram, self.known, self.n_docs, self.min_df)
            else:
                docs = statistics(self.counts, self.found, self.vocab, self.partitions)
            self._made["docs"] = docs.persist()
        return self._made["docs"]

    def average(self) -> float:
        """Words of a document, on average."""
        if not self._average:
            self._average.append(self.totals.first()["avg_len"])
        return self._average[0]

    def release(self) -> None:
        """Let go of the statistics; they are computed anew if they are used again."""
        for kept in (self.counts, self.found, self._made.pop("docs", None)):
            if kept is not None:
                kept.unpersist()

    def weights(self) -> DataFrame:
        """doc_id, t, w: unit vectors, or as they are if their length is next to nothing."""
        rows = self.counts.join(self.vocab.select("t", "idf"), "t").where("idf IS NOT NULL").join(self.docs, "doc_id")
        return rows.select("doc_id", "t", (tfidf_weight(F.col("n"), F.col("idf")) / F.when(F.col("norm") <= 1e-12, 1.0).otherwise(F.col("norm"))).alias("w"))
