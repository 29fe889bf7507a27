"""Quality classification with supervised subword embeddings.

A document's features are its words and the character n-grams (3 and 4 bytes) of its words with their ends marked,
hashed to buckets; its vector is the mean of their learned embeddings, and a softmax layer scores the two labels.
Embeddings and layer are trained together by stochastic gradient descent. For scoring, the layer is folded into the
embeddings (both are linear), so a word costs one look-up.

Fitted on a bounded sample of at most `sample` labelled ids outside the held-out fold, half of each label, and of up
to four different texts of an id; scoring covers every row and whole texts. Without any usable label all scores are 0.5.

Defined results: null and empty texts have no features and get the score of the bias alone. Labels other than 0 and
1 are left out, as are null ids of labels. A document with different labels gives a training example for each. An
empty table gives no rows. Only the id, text and label columns are looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_fold, importable, per_text

BITS = 14  # buckets for words, and as many for n-grams
#: Different texts under one labelled id that are learnt from.
TEXTS_OF_AN_ID = 4
#: Words whose features a scoring task remembers at most.
MEMORY = 300_000


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all words' features, and how many each word has: itself, then its n-grams."""
    joined = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    end_of = np.repeat(ends, sizes)
    start_of = np.repeat(starts, sizes)
    at = np.arange(len(joined))
    # A word's hash: its bytes, each weighed by a mix of its place in the word.
    mixed = (joined + np.uint64(1)) * ((at - start_of).astype(np.uint64) * np.uint64(2654435769) + np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
    buckets, owners = [whole >> np.uint64(64 - BITS)], [np.arange(len(words))]
    owner = np.repeat(np.arange(len(words)), sizes)
    for n in (3, 4):
        ok = np.flatnonzero(at + n <= end_of)
        h = np.full(len(ok), n, np.uint64)
        for k in range(n):
            h = (h ^ joined[ok + k]) * np.uint64(0x100000001B3)
        buckets.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)) + np.uint64(1 << BITS))
        owners.append(owner[ok])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(buckets).astype(np.int64)[order], np.bincount(np.concatenate(owners), minlength=len(words))


def _bag(text: str | None) -> tuple[bytes, bytes]:
    """A document's buckets and their counts."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return b"", b""
    kinds, inverse = np.unique(np.array(words, object), return_inverse=True)
    buckets, n = word_features(kinds.tolist())
    weight = np.repeat(np.bincount(inverse, minlength=len(kinds)), n)
    total = np.bincount(buckets, weights=weight, minlength=2 << BITS)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32).tobytes(), total[ids].astype(np.int32).tobytes()


class Model:
    """One weight per bucket (embedding times layer) and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        place: dict[bytes, int] = {}
        sums, counts = np.zeros(MEMORY * 2), np.zeros(MEMORY * 2)

        def learn(words: list[bytes]) -> None:
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                buckets, n = word_features(part)
                first = len(place)
                sums[first : first + len(part)] = np.add.reduceat(self.weights[buckets], np.cumsum(n) - n)
                counts[first : first + len(part)] = n
                place.update(zip(part, range(first, first + len(part)), strict=True))

        def score(texts: list) -> list:
            logits = []
            for text in texts:
                words = (text or "").encode("utf-8", "replace").split()
                total = seen = 0.0
                for at in range(0, len(words), MEMORY):  # as many as fit at once
                    part = words[at : at + MEMORY]
                    if len(place) + len(new := [w for w in dict.fromkeys(part) if w not in place]) > 2 * MEMORY:
                        place.clear()
                        new = list(dict.fromkeys(part))
                    if new:
                        learn(new)
                    ids = np.fromiter(map(place.__getitem__, part), np.int64, len(part))
                    total += sums[ids].sum()
                    seen += counts[ids].sum()
                logits.append(total / max(seen, 1) + self.bias)
            p = 1 / (1 + np.exp(-np.clip(logits, -500, 500))) if texts else np.empty(0)
            return [p, (p >= 0.5).astype(np.int32)]

        return score


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, dim: int = 16, epochs: int = 12, rate: float = 0.5, batch: int = 16, seed: int = 6) -> Model:
    """Stochastic gradient descent on the two-label softmax; both labels weigh the same."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (2 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    share = np.array([0.5 / max((labels == k).mean(), 1e-9) for k in (0, 1)])
    steps, step = epochs * -(-len(bags) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            sizes = [len(bags[i][0]) for i in part]
            ids = np.concatenate([bags[i][0] for i in part])
            weight = np.concatenate([bags[i][1] / bags[i][1].sum() if len(bags[i][1]) else bags[i][1] for i in part]).astype(np.float32)
            owner = np.repeat(np.arange(len(part)), sizes)
            vectors = _sums(table[ids] * weight[:, None], sizes)
            z = vectors @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            p *= share[labels[part]][:, None] / len(part)
            now = rate * (1 - step / steps)
            back = p @ layer.T
            layer -= now * vectors.T @ p
            bias -= now * 0.1 * p.sum(0)
            # The mean spreads a gradient over a text's features; scaled up, rare features still move.
            np.subtract.at(table, ids, now * 50 * weight[:, None] * back[owner])
            step += 1
    return Model((table @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def _sums(rows: np.ndarray, sizes: list[int]) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = np.concatenate([np.zeros((1, rows.shape[1]), np.float64), np.cumsum(rows, 0, dtype=np.float64)])
    return (total[ends] - total[ends - sizes]).astype(np.float32)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2400, **options) -> Model:
    importable(spark)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (crc_fold(F.col("id")) != 1))
    marked = marked.distinct()
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    # The ids whose hashes are lowest; before they are ordered, they are thinned to a few times as many.
    each, share = sample // 2, F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, (4 * each + 20) / n))) for k, n in counts.items()], F.lit(0.0))
    turn = F.row_number().over(Window.partitionBy("label").orderBy("share", "id"))
    drawn = marked.withColumn("share", share).where(F.col("share") < rate).withColumn("turn", turn).where(F.col("turn") <= each).select("id", "label")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").dropDuplicates(["id", "label", "text"])
    turn = F.row_number().over(Window.partitionBy("id", "label").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("turn", turn).where(F.col("turn") <= TEXTS_OF_AN_ID).select("label", "text")

    def make():
        return lambda texts: list(zip(*map(_bag, texts), strict=True)) if texts else [[], []]

    bags = sorted((bytes(r["ids"]), bytes(r["counts"]), r["label"]) for r in per_text(rows, "label", "text", make, "ids binary, counts binary").collect())
    if len({x[2] for x in bags}) < 2:
        return Model(np.zeros(2 << BITS), 0.0)
    return train([(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for a, b, _ in bags], np.array([x[2] for x in bags]), **options)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted for every row."""
    return per_text(docs, id_col, text_col, model.scorer, "score double, predicted int")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return predict(docs, model).select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")
