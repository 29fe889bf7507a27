"""Queries scored against the postings of each document, as products of matrices.

A query of some length shares a token with nearly every document, so rows for each token, query and document would be
many times the input. Postings are counted from a portion of texts, and numpy scores it at once against all queries.
Tokens that many queries have are columns of a dense matrix; others are unfolded into their few queries. A task returns
what can be among a query's first documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.postings import Postings, portions
from lodestone.workers import importable

#: Queries scored at once, and queries of a token from which on it has a column.
QUERIES, DENSE = 512, 6
#: Vectors that meet the queries at once, cosines held at once, and by how much cosines may differ from what rounding to 6 places makes equal.
VECTORS, CELLS, MARGIN = 2_000, 8_000_000, 2e-6
ROLES = ("whole", "head", "tail")


def _rounded(x: np.ndarray, places: int) -> np.ndarray:
    return np.floor(x * 10**places + 0.5) / float(10**places)


class Block:
    """Some queries: for each of their tokens who asks for it, and with which weights."""

    def __init__(self, first: int, size: int, n_tokens: int, token, query, weights: np.ndarray, most: np.ndarray):
        # weights: qw, qn, whole, head, tail and 1, for each row of token and query
        self.first, self.size, self.most = first, size, most
        asked = np.bincount(token, minlength=n_tokens)
        self.column = np.where(asked >= DENSE, np.cumsum(asked >= DENSE) - 1, -1)
        dense = self.column[token] >= 0
        self.matrices = np.zeros((weights.shape[0], int((asked >= DENSE).sum()), size))
        self.matrices[:, self.column[token[dense]], query[dense]] = weights[:, dense]
        order = np.argsort(token[~dense], kind="stable")
        self.query, self.weights = query[~dense][order], weights[:, ~dense][:, order]
        self.count = np.where(asked >= DENSE, 0, asked)
        self.start = np.cumsum(self.count) - self.count

    def sums(self, doc: np.ndarray, n_docs: int, token: np.ndarray, values: list[np.ndarray], which: list[int]) -> list[np.ndarray]:
        """For each pair of values (of postings) and weights: their products, summed by document and query."""
        column, count = self.column[token], self.count[token]
        dense = np.flatnonzero(column >= 0)
        at = np.repeat(np.arange(len(token)), count)
        row = np.repeat(self.start[token] - (np.cumsum(count) - count), count) + np.arange(len(at))
        cell = doc[at] * self.size + self.query[row]
        out, last, filled = [], None, None
        for v, k in zip(values, which, strict=True):
            if v is not last:
                filled, last = np.zeros((n_docs, self.matrices.shape[1])), v
                filled[doc[dense], column[dense]] = v[dense]
            rest = np.bincount(cell, v[at] * self.weights[k][row], minlength=n_docs * self.size)
            out.append(filled @ self.matrices[k] + rest.reshape(n_docs, self.size))
        return out


class Best:
    """Of the rows that it gets, q, doc_id and score first, those that are among the first `top` of their q; ties go to
    the smaller id."""

    def __init__(self, top: int, n_queries: int):
        self.top, self.least, self.held, self.most = top, np.full(n_queries, -np.inf), [], 8 * top * n_queries

    def add(self, rows: pa.RecordBatch) -> None:
        self.held.append(rows)
        if sum(x.num_rows for x in self.held) > self.most:
            self.rows()

    def rows(self) -> pa.Table:
        rows = pa.Table.from_batches(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        q = rows["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        rows = rows.filter(pa.array(place < self.top))
        last = place[place < self.top] == self.top - 1
        self.least[rows["q"].to_numpy()[last]] = rows["score"].to_numpy()[last]
        self.held = rows.combine_chunks().to_batches()
        return rows


def scores(engine, tokens: DataFrame, top: int | None = None) -> DataFrame:
    """qid, doc_id, sim, bm25_raw, bm25 and content hits, for documents that share a token with the query; with top, at
    least those of them whose recall score is among the query's first ones (ties go to the smaller id). tokens must be
    small: they go to the driver, and from there to all tasks, as does what the index knows of its tokens."""
    index, k1, b = engine.index, engine.k1, engine.b
    spark = tokens.sparkSession
    importable(spark)
    stats = {r["qid"]: r["most"] for r in engine.query_stats(tokens).collect()}
    rows = tokens.select("qid", "t", "qw", "qn", *ROLES, "idf", "bidf").collect()
    qids = list(stats)
    place, number = {q: i for i, q in enumerate(qids)}, {}
    token = np.array([number.setdefault(r["t"], len(number)) for r in rows], np.int64)
    query = np.array([place[r["qid"]] for r in rows], np.int64)
    idf, bidf = np.zeros(len(number)), np.zeros(len(number))
    idf[token], bidf[token] = [r["idf"] or 0.0 for r in rows], [r["bidf"] or 0.0 for r in rows]
    weights = np.array([[r["qw"] or 0.0, r["qn"], *[r[x] for x in ROLES], 1] for r in rows], np.float64).reshape(-1, 6).T
    most = np.array([stats[q] for q in qids], np.float64)
    blocks = []
    for first in range(0, len(qids), QUERIES):
        size = min(QUERIES, len(qids) - first)
        own = (query >= first) & (query < first + size)
        blocks.append(Block(first, size, len(number), token[own], query[own] - first, weights[:, own], most[first : first + size]))
    sent = spark.sparkContext.broadcast((blocks, idf, bidf, number, index.known))
    average, by_sim, by_bm25 = index.average(), engine.weights["sim"], engine.weights["bm25"]
    char_ngram, n_docs, min_df, n_queries = index.char_ngram, index.n_docs, index.min_df, len(qids)
    columns = ["q", "doc_id", "score", "sim", "bm25_raw", "bm25", *[f"hit_{r}" for r in ROLES]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, idf, bidf, number, known = sent.value
        postings, best = Postings(char_ngram, *known, n_docs, min_df, number), Best(top, n_queries) if top else None
        for batch in batches:
            for part in portions(batch):
                doc, t, n, wn, dl, norm, _ = postings(part.column(1))
                used, doc = np.unique(doc, return_inverse=True)
                if not len(used):
                    continue
                ids, dl, norm = part.column(0).take(pa.array(used)), np.where(dl == 0, 1, dl)[used][doc], np.where(norm <= 1e-12, 1.0, norm)[used][doc]
                like = (1.0 + np.log(n)) * idf[t] / norm
                part_of = np.where(wn > 0, bidf[t] * (wn * (k1 + 1)) / (wn + k1 * (1 - b + b * dl / average)), 0.0)
                word, one = (wn > 0).astype(float), np.ones(len(t))
                for block in blocks:
                    sim, raw = block.sums(doc, len(used), t, [like, part_of], [0, 1])
                    sim, bm25 = _rounded(sim, 4), _rounded(np.minimum(raw / block.most, 1.0), 4)
                    total = _rounded(by_sim * sim + by_bm25 * bm25, 4)
                    keep = total >= best.least[block.first : block.first + block.size] if best else np.ones(total.shape, bool)
                    # Hits of the documents that some query keeps.
                    some = np.flatnonzero(keep.any(1))
                    if not len(some):
                        continue
                    new = np.full(len(used), -1)
                    new[some] = np.arange(len(some))
                    own = new[doc] >= 0
                    *hits, shared = block.sums(new[doc[own]], len(some), t[own], [word[own], word[own], word[own], one[own]], [2, 3, 4, 5])
                    at, q = np.nonzero(keep[some] & (shared > 0.5))
                    d = some[at]
                    found = [pa.array(q + block.first, pa.int32()), ids.take(pa.array(d)), *[pa.array(x[d, q]) for x in (total, sim, _rounded(raw, 3), bm25)], *[pa.array(np.rint(x[at, q]).astype(np.int64)) for x in hits]]
                    found = pa.RecordBatch.from_arrays(found, columns)
                    if best:
                        best.add(found)
                    else:
                        yield found
        if best and best.held:
            yield from best.rows().to_batches()

    kind = index.rows.schema["doc_id"].dataType.simpleString()
    found = index.rows.where("doc_id IS NOT NULL").mapInArrow(score, f"q int, doc_id {kind}, score double, sim double, bm25_raw double, bm25 double, hit_whole long, hit_head long, hit_tail long")
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(qids)], f"q int, qid {tokens.schema['qid'].dataType.simpleString()}")
    return found.join(F.broadcast(asked), "q").drop("q", "score")


def close(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, key, _q, _v of unit vectors (key, _v) that can be among the k nearest to a query (query_id, _q): in each
    portion those that are no farther than the k-th there, and all that rounding may make equal to it. A vector doesn't
    meet the query of its own id."""
    spark = vectors.sparkSession
    importable(spark)
    asked = queries.where("query_id IS NOT NULL").toArrow().combine_chunks()
    if not asked.num_rows:
        return vectors.where("false").select(F.col(key).alias("query_id"), key, F.col("_v").alias("_q"), "_v")
    own = _whole(asked["query_id"])
    sent = spark.sparkContext.broadcast((own, *_matrix(_whole(asked["_q"]))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, no_query = sent.value
        known = ids.unique()
        at = np.asarray(pa.compute.index_in(ids, value_set=known))
        for batch in batches:
            portion = max(1, min(VECTORS, CELLS // len(q)))
            for first in range(0, batch.num_rows, portion):
                part = batch.slice(first, portion)
                v, no_vector = _matrix(part["_v"])
                width = min(v.shape[1], q.shape[1])  # beyond the shorter one products are zero
                cosine = q[:, :width] @ v[:, :width].T
                cosine[np.isnan(cosine)] = np.inf  # NaN is first in Spark's order, null last
                cosine[no_query, :], cosine[:, no_vector] = -3.0, -3.0
                same = pa.compute.fill_null(pa.compute.index_in(part[key], value_set=known.cast(part[key].type)), -1)
                for j, u in enumerate(np.asarray(same)):
                    if u >= 0:
                        cosine[at == u, j] = -np.inf
                least = np.partition(cosine, -k, axis=1)[:, -k] if cosine.shape[1] > k else np.full(len(q), -np.inf)
                i, j = np.nonzero((cosine >= least[:, None] - MARGIN) & (cosine > -np.inf))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)).cast(part[key].type), part[key].take(pa.array(j))], ["query_id", key])

    kind = vectors.schema[key].dataType.simpleString()
    pairs = vectors.where(F.col(key).isNotNull()).mapInArrow(near, f"query_id {kind}, {key} {kind}")
    return pairs.distinct().join(vectors, key).join(F.broadcast(queries), "query_id").select("query_id", key, "_q", "_v")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def _matrix(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, filled up with zeros where they are shorter or null; and which of them are null."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(rows), 0))
    out = np.zeros((len(rows), max(size, default=0)))
    flat = np.asarray(pa.compute.fill_null(rows.flatten(), 0.0))
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, np.asarray(rows.is_null().to_numpy(zero_copy_only=False))
