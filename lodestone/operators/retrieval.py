"""Recall and rerank as one plan over query and document tables.

Only postings of query tokens are scored: the query side is small and its size is checked before it is broadcast.
Postings are scored and summed where the texts are read; what is shuffled is what a task finds to be among a query's
first documents. Which terms a document covers is found for the pool alone. Documents that share no token with a query
score 0 and matter only if the pool isn't full; then the first documents in id order fill it, and no query meets every
document. Features beside similarity and BM25 are made for the pool.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import dot, l2_normalize, rounded, share
from lodestone.functions.text import CONTRAST, char_ngrams, content, contrast, tokenize
from lodestone.operators import scoring
from lodestone.operators.index import B, K1, Index, bm25_part, tfidf_weight, token_counts
from lodestone.operators.sizes import is_small, settled
from lodestone.sources.tables import Corpus

# The weights of the features, and the penalty for each earlier result of the same answer group.
WEIGHTS = {"sim": 0.45, "bm25": 0.12, "coverage": 0.13, "title": 0.16, "cat": 0.04, "helpful": 0.02, "clause": 0.12, "dup": 0.08}
FEATURES = ("sim", "bm25", "coverage", "title", "cat", "helpful", "clause")
POOL, TOP, RRF = 10, 5, 60
#: Rows of pools that may be broadcast.
POOL_ROWS = 200_000
#: Query vectors that may be broadcast at once.
QUERY_BLOCK = 10_000


@dataclass
class Retrieval:
    """A corpus ready for search. weights override the defaults one by one."""

    corpus: Corpus
    weights: dict[str, float] = field(default_factory=dict)
    pool_size: int = POOL
    markers: Sequence[str] = CONTRAST
    k1: float = K1
    b: float = B
    _index: Index | None = None
    _kept: list[DataFrame] = field(default_factory=list)

    def __post_init__(self):
        if self.pool_size < 1:
            raise ValueError("pool_size must be at least 1")
        if unknown := set(self.weights) - set(WEIGHTS):
            raise ValueError(f"no such weights: {sorted(unknown)}")
        self.weights = WEIGHTS | self.weights

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index.of(self.corpus.plain, self.corpus.indexed_text())
        return self._index

    def query_tokens(self, queries: DataFrame) -> DataFrame:
        """qid, t, qw (unit TF-IDF weight), qn (times said as a word), idf, bidf, and whether t is content of the whole,
        the head, the tail."""
        parts = queries.select("qid", "q", contrast("q", self.markers).alias("c"))
        words = parts.select(
            "qid", tokenize("q").alias("w"), char_ngrams("q").alias("g"), content(tokenize("q")).alias("whole"),
            content(tokenize(F.col("c.head"))).alias("head"), content(tokenize(F.col("c.tail"))).alias("tail"),
        )
        roles = F.concat(
            *[_as_role(c, role) for c, role in (("w", "word"), ("g", "gram"), ("whole", "whole"), ("head", "head"), ("tail", "tail"))]
        )
        rows = words.select("qid", F.explode_outer(roles).alias("x")).where("x IS NOT NULL").select("qid", "x.t", "x.role")
        said = lambda role: F.sum((F.col("role") == role).cast("int"))
        rows = rows.groupBy("qid", "t").agg(said("word").alias("qn"), said("gram").alias("gn"), *[(said(r) > 0).alias(r) for r in ("whole", "head", "tail")])
        vocab = self.index.vocab
        if is_small(rows):
            vocab = vocab.join(F.broadcast(rows.select("t").distinct()), "t", "left_semi")
        rows = rows.join(vocab, "t", "left")
        raw = F.when((F.col("qn") + F.col("gn") > 0) & F.col("idf").isNotNull(), tfidf_weight(F.col("qn") + F.col("gn"), F.col("idf")))
        norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("qid")))
        return rows.select("qid", "t", "qn", "whole", "head", "tail", "idf", "bidf", (raw / F.when(norm <= 1e-12, 1.0).otherwise(norm)).alias("qw"))

    def query_stats(self, tokens: DataFrame) -> DataFrame:
        """qid, most (what BM25 can reach), and the sizes of the content sets."""
        most = F.greatest(F.sum(F.when(F.col("qn") > 0, F.coalesce("bidf", F.lit(0.0)))) * (self.k1 + 1), F.lit(1e-6))
        any_word = F.sum("qn") > 0
        return tokens.groupBy("qid").agg(F.when(any_word, most).otherwise(1.0).alias("most"), *[F.sum(F.col(r).cast("int")).alias(f"n_{r}") for r in ("whole", "head", "tail")])

    def _few(self, tokens: DataFrame) -> bool:
        """Whether the queries' tokens, and what is known of the corpus's, are small enough to go to all tasks."""
        return is_small(tokens) and self.index.known is not None

    def _asked(self, queries: DataFrame) -> DataFrame:
        tokens = settled(self.query_tokens(queries))
        self._kept.append(tokens)
        return tokens

    def release(self) -> None:
        """Let go of all that is kept for later searches."""
        for kept in self._kept:
            kept.unpersist()
        self._kept.clear()
        if self._index is not None:
            self._index.release()
            self._index = None

    def matches(self, queries: DataFrame, tokens: DataFrame) -> DataFrame:
        """qid, doc_id, sim, bm25_raw, bm25 and content hits, for documents that share a token."""
        if self._few(tokens):
            return scoring.scores(self, tokens)
        # Statistics of documents are looked up by hash, and nothing is sorted.
        posts = self.index.counts.join(tokens, "t").join(self.index.docs.hint("shuffle_hash"), "doc_id")
        norm = F.when(F.col("norm") <= 1e-12, 1.0).otherwise(F.col("norm"))
        dot = F.sum(F.col("qw") * tfidf_weight(F.col("n"), F.col("idf")) / norm)
        part = F.when((F.col("wn") > 0) & (F.col("qn") > 0), bm25_part(F.col("qn"), F.col("bidf"), F.col("wn"), F.col("dl"), F.lit(self.index.average()), self.k1, self.b))
        hit = lambda role: F.sum((F.col(role) & (F.col("wn") > 0)).cast("int")).alias(f"hit_{role}")
        rows = posts.groupBy("qid", "doc_id").agg(F.coalesce(dot, F.lit(0.0)).alias("sim"), F.coalesce(F.sum(part), F.lit(0.0)).alias("bm25_raw"), hit("whole"), hit("head"), hit("tail"))
        stats = self.query_stats(tokens)
        rows = rows.join(stats, "qid")
        return rows.withColumns({"sim": rounded(F.col("sim")), "bm25": rounded(F.least(F.col("bm25_raw") / F.col("most"), F.lit(1.0))), "bm25_raw": rounded(F.col("bm25_raw"), 3)})

    def _score(self) -> Column:
        return rounded(F.lit(self.weights["sim"]) * F.col("sim") + F.lit(self.weights["bm25"]) * F.col("bm25"))

    def recall(self, queries: DataFrame, top_n: int | None = None) -> DataFrame:
        """qid, doc_id, recall_rank, recall_score, sim, bm25, bm25_raw and content hits of the pool; 0 means the pool
        size. Ties go to the smaller id."""
        return self._pool(queries, self._asked(queries), top_n or self.pool_size)

    def _pool(self, queries: DataFrame, tokens: DataFrame, top_n: int) -> DataFrame:
        if top_n < 1:
            raise ValueError("top_n must be at least 1")
        scored = scoring.scores(self, tokens, 2 * top_n) if self._few(tokens) else self.matches(queries, tokens)
        scored = scored.select("qid", "doc_id", "sim", "bm25_raw", "bm25", "hit_whole", "hit_head", "hit_tail").withColumn("recall_score", self._score())
        best = Window.partitionBy("qid").orderBy(F.desc("recall_score"), "doc_id")
        scored = settled(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= 2 * top_n).drop("r"))
        self._kept.append(scored)
        # The 2n first documents hold the n first of those that score nothing, whenever fewer than n score.
        first = self.corpus.plain.select("doc_id").orderBy("doc_id").limit(2 * top_n)
        fill = queries.select("qid").crossJoin(F.broadcast(first)).join(scored.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        zero = F.lit(0.0)
        fill = fill.select("qid", "doc_id", zero.alias("sim"), zero.alias("bm25_raw"), zero.alias("bm25"), *[F.lit(0).cast("long").alias(f"hit_{r}") for r in ("whole", "head", "tail")], zero.alias("recall_score"))
        # A document scored but cut above ranks below 2n, and so does it here.
        rows = scored.unionByName(fill).withColumn("recall_rank", F.row_number().over(best)).where(F.col("recall_rank") <= top_n)
        return rows.join(self.query_stats(tokens), "qid", "left").na.fill(0, ["n_whole", "n_head", "n_tail"])

    def _covered(self, pool: DataFrame, tokens: DataFrame, docs: DataFrame | None) -> DataFrame:
        """qid, doc_id, covered_terms: the content words of the query that the document has, where it has any. docs: the
        documents of the pool, if they are few."""
        wanted = pool.select("qid", "doc_id").join(tokens.where("whole").select("qid", "t"), "qid")
        counts = self.index.counts if docs is None else token_counts(docs, "doc_id", self.corpus.indexed_text(), char_ngram=False)
        rows = counts.where("wn > 0").select("doc_id", "t").join(wanted if docs is None else F.broadcast(wanted), ["doc_id", "t"])
        return rows.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_list("t")).alias("covered_terms"))

    def features(self, queries: DataFrame, top_n: int | None = None, pool: DataFrame | None = None) -> DataFrame:
        """The pool with all features. pool: what recall() gave for the same arguments, if it's there."""
        about = queries.select("qid", "q", content(tokenize("q")).alias("said"), F.array_distinct(char_ngrams("q")).alias("grams"), contrast("q", self.markers).isNotNull().alias("turns"))
        top_n, tokens = top_n or self.pool_size, self._asked(queries)
        few = queries.count() * top_n <= POOL_ROWS and tokens.where("whole").count() * top_n <= POOL_ROWS
        if pool is None:
            pool = settled(self._pool(queries, tokens, top_n))
            self._kept.append(pool)
        docs = self.corpus.docs
        if few:  # the documents of the pool alone
            docs = settled(self.corpus.chosen(pool.select("doc_id").distinct()))
            self._kept.append(docs)
        covered = self._covered(pool, tokens, docs if few else None)
        pool = pool.join(covered, ["qid", "doc_id"], "left").withColumn("covered_terms", F.coalesce("covered_terms", F.array().cast("array<string>")))
        rows = docs.join(F.broadcast(pool) if few else pool, "doc_id").join(F.broadcast(about) if few else about, "qid")
        title = content(tokenize("title"))
        title_cover = share(F.size(F.array_intersect("said", title)), F.size("said"))
        overlap = share(F.size(F.array_intersect("grams", F.array_distinct(char_ngrams("title")))), F.size("grams"))
        cover = lambda r: share(F.col(f"hit_{r}"), F.col(f"n_{r}"))
        return rows.withColumns({
            "coverage": rounded(cover("whole")), "title_cover": rounded(title_cover), "gram_overlap": rounded(overlap),
            "title_hit": rounded(0.6 * title_cover + 0.4 * overlap), "cat_hit": F.contains("q", "cat").cast("double"), "helpful_hit": F.col("helpful").cast("double"),
            "clause": F.when(F.col("turns"), rounded(cover("tail") - cover("head"))).otherwise(0.0), "missed_terms": F.slice(F.sort_array(F.array_except("said", "covered_terms")), 1, 6),
        })

    def _feature(self, name: str) -> Column:
        return F.coalesce(F.col({"title": "title_hit", "cat": "cat_hit", "helpful": "helpful_hit"}.get(name, name)), F.lit(0.0))

    def rerank(self, queries: DataFrame, top_k: int = TOP, pool: DataFrame | None = None) -> DataFrame:
        """Results with final_rank up to top_k; rank_delta is positive for what moved up within the pool."""
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        return self.reranked(self.features(queries, pool=pool), top_k)

    def reranked(self, features: DataFrame, top_k: int = TOP) -> DataFrame:
        """rerank() for features that are there already."""
        earlier = F.row_number().over(Window.partitionBy("qid", "grp").orderBy(F.desc("recall_score"), "doc_id")) - 1
        rows = features.withColumn("dup_count", earlier)
        score = self._feature("sim") * self.weights["sim"]
        for name in FEATURES[1:]:
            score = score + self._feature(name) * self.weights[name]
        rows = rows.withColumn("final_score", rounded(score - F.col("dup_count") * self.weights["dup"]))
        rows = rows.withColumn("final_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final_score"), "doc_id")))
        rows = rows.withColumn("rank_delta", F.col("recall_rank") - F.col("final_rank"))
        parts = [x for name in FEATURES for x in (F.lit(name), rounded(self._feature(name) * self.weights[name]))]
        return rows.withColumn("contrib", F.create_map(*parts)).where(F.col("final_rank") <= top_k)

    def search(self, queries: DataFrame, top_k: int = TOP, use_rerank: bool = True, pool: DataFrame | None = None) -> DataFrame:
        """What a search returns, per query and result. Without rerank the final score is the recall score."""
        if use_rerank:
            return self.rerank(queries, top_k, pool)
        if top_k < 1:
            raise ValueError("top_k must be at least 1")
        rows = self.features(queries, pool=pool).where(F.col("recall_rank") <= top_k)
        none = F.create_map().cast("map<string,double>")
        return rows.withColumns({"final_score": F.col("recall_score"), "final_rank": F.col("recall_rank"), "rank_delta": F.lit(0), "contrib": none, "dup_count": F.lit(0)})

    def fused(self, queries: DataFrame, top_k: int = TOP, constant: int = RRF) -> DataFrame:
        """Reciprocal rank fusion of similarity and raw BM25 within the pool. Ties keep the order of recall in each
        list, and go to the smaller id in the fused one."""
        return self.fuse(self.recall(queries), top_k, constant)

    def fuse(self, pool: DataFrame, top_k: int = TOP, constant: int = RRF) -> DataFrame:
        """fused() for a pool that is there already."""
        rank = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "recall_rank"))
        rows = pool.withColumns({"sim_rank": rank("sim"), "bm25_rank": rank("bm25_raw")})
        rows = rows.withColumn("rrf", rounded(1.0 / (constant + F.col("sim_rank")) + 1.0 / (constant + F.col("bm25_rank")), 10))
        return rows.withColumn("rrf_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rrf"), "doc_id"))).where(F.col("rrf_rank") <= top_k)


def _as_role(tokens: str, role: str) -> Column:
    return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(role).alias("role")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest by cosine of unit vectors; ties go to the smaller id. Queries go to all tasks, in blocks if they are
    many. Every vector meets every query in a product of matrices, which leaves of each portion what can be among the k
    nearest; the cosines of those are computed one by one."""
    left = queries.select(F.col(key).alias("query_id"), l2_normalize(F.col(vector)).alias("_q"))
    right = vectors.select(key, l2_normalize(F.col(vector)).alias("_v"))
    n = left.count()
    blocks = 1 if n <= QUERY_BLOCK else -(-2 * n // QUERY_BLOCK)  # half full, so that hashing fills none beyond its size
    at = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [scoring.close(right, left if blocks == 1 else left.where(at == i), k, key) for i in range(blocks)]
    rows = reduce(DataFrame.unionByName, found).select("query_id", key, rounded(dot(F.col("_q"), F.col("_v")), 6).alias("cosine"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), key))).where(F.col("rank") <= k)
