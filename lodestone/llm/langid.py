"""Language identification with string kernels.

Texts become presence sets of blended n-grams (1 to 3 symbols; letters fold to 63 classes, runs of anything else to
one). The kernel of two texts is the size of their sets' intersection over the geometric mean of the sizes. Landmark
texts span a Nyström feature space, in which one ridge regression per language is solved against the rest. Scoring a
batch is matrix products: presence by landmarks, then by the folded regression weights.

The model is fitted on a bounded sample: `sample` labelled rows at most, split evenly over all languages there are,
and one of each at least; each language has at least one landmark. Everything else covers every row and whole texts.

A text is known to the degree that landmarks have its n-grams. accepted() rejects texts without a letter, and those
known to less than three quarters of what all but one in a hundred of the fitted texts are (each by the other
landmarks): texts of a language that was not learnt, or of none.

Defined results: `und` with score 0 if a text is null or has no letter, or if nothing could be learnt. Ties go to
the language first in code point order. Null ids are allowed and count as empty text for the fold. An empty table
gives no rows. Only the id, text and language columns are looked at.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_fold, forget, importable, per_text, portions

UND = "und"
SYMBOLS, WIDTH = 64, 64 + 64**2 + 64**3
#: Steepness of the softmax over regression outputs.
SCALE = 6.0


@functools.cache
def _symbols() -> np.ndarray:
    """Code point below 65536 to symbol: 1-26 for a-z, 27-63 for other letters, 0 for the rest."""
    table = np.zeros(1 << 16, np.int32)
    for cp in range(1 << 16):
        low = chr(cp).lower()[0]
        if low.isalpha():
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
    return table


class Presence:
    """n-grams of one text at a time, over a bitmap that is reused."""

    def __init__(self):
        self.seen = np.zeros(WIDTH, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        """The ids of all n-grams present, ascending; none if there is no letter."""
        points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
        s = _symbols()[np.minimum(points, 0xFFFF)]
        if len(high := np.flatnonzero(points > 0xFFFF)):
            s[high] = [27 + p % 37 if chr(p).isalpha() else 0 for p in points[high].tolist()]
        s = np.concatenate(([0], s, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        if len(s) < 2 or not s.any():
            return np.empty(0, np.int64)
        pairs = s[:-1] * 64 + s[1:]
        self.seen[s] = True
        self.seen[64 + pairs] = True
        if len(s) > 2:
            self.seen[64 + 4096 + pairs[:-1] * 64 + s[2:]] = True
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found


class Model:
    """Landmark n-grams and weights; all that a scoring task needs."""

    def __init__(self, langs: list[str], column: np.ndarray, landmarks: np.ndarray, weights: np.ndarray, least: float):
        self.langs, self.column, self.landmarks, self.weights, self.least = langs, column, landmarks, weights, least

    def scorer(self):
        present, batch = Presence(), 128

        def score(texts: list) -> list:
            langs, scores, known = [], [], []
            for at in range(0, len(texts), batch):
                sets = [present(t) for t in texts[at : at + batch]]
                x = np.zeros((len(sets), self.landmarks.shape[0]), np.float32)
                for row, ids in zip(x, sets, strict=True):
                    row[self.column[ids]] = 1
                x[:, 0] = 0  # where n-grams go that no landmark has
                norm = np.sqrt([max(len(ids), 1) for ids in sets])[:, None]
                f = (x @ self.landmarks / norm) @ self.weights
                p = np.exp(SCALE * (f - f.max(1, keepdims=True)))
                best = f.argmax(1)
                top = p[np.arange(len(sets)), best] / p.sum(1)
                for ids, k, v in zip(sets, best.tolist(), top.tolist(), strict=True):
                    langs.append(self.langs[k] if len(ids) else UND)
                    scores.append(float(v) if len(ids) else 0.0)
                    known.append(np.count_nonzero(self.column[ids]) / len(ids) if len(ids) else 0.0)
            return [langs, scores, known]

        return score


def solve(texts: list[tuple[str, np.ndarray]], landmarks: int, ridge: float) -> Model | None:
    """Fit on (language, presence set) pairs; the first of each language in turn are landmarks."""
    texts = [(lang, ids) for lang, ids in texts if len(ids)]
    langs = sorted({lang for lang, _ in texts})
    if not langs:
        return None
    by: dict[str, list[np.ndarray]] = {}
    for lang, ids in texts:
        by.setdefault(lang, []).append(ids)
    landmarks = max(landmarks, len(langs))
    marks = [ids for turn in range(max(map(len, by.values()))) for k in langs for ids in by[k][turn : turn + 1]][:landmarks]
    known = np.unique(np.concatenate(marks))
    column = np.zeros(WIDTH, np.int32)
    column[known] = np.arange(1, len(known) + 1)
    table = np.zeros((len(known) + 1, len(marks)), np.float32)
    for j, ids in enumerate(marks):
        table[column[ids], j] = 1 / np.sqrt(len(ids))
    kernel = lambda sets: np.array([table[column[ids]].sum(0, dtype=np.float64) - (column[ids] == 0).sum() * table[0] for ids in sets]) / np.sqrt([[len(ids)] for ids in sets])
    values, vectors = np.linalg.eigh(kernel(marks))
    root = vectors[:, keep := values > 1e-6] / np.sqrt(values[keep])
    features = kernel([ids for _, ids in texts]) @ root
    wanted = np.array([[1.0 if lang == k else -1.0 for k in langs] for lang, _ in texts])
    share = np.array([1 / len(by[lang]) for lang, _ in texts])[:, None]  # each language weighs the same
    gram = features.T @ (features * share) + ridge * np.eye(features.shape[1])
    chosen = {id(ids) for ids in marks}
    said = np.bincount(np.concatenate(marks), minlength=WIDTH)
    known = [float((said[ids] > (id(ids) in chosen)).mean()) for _, ids in texts]
    return Model(langs, column, table, (root @ np.linalg.solve(gram, features.T @ (wanted * share))).astype(np.float32), 0.75 * float(np.quantile(known, 0.01)))


def fit(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1600, landmarks: int = 128, ridge: float = 1e-3) -> Model | None:
    """Learn from rows outside the held-out fold that have a language."""
    importable(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("id")) != 1))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("id", "text")).alias("n")).collect()  # a row for each language
    if not counts:
        return None
    each = max(1, sample // len(counts))
    # The rows whose hashes are lowest, each once; before they are ordered, rows are thinned to a few times as many.
    rates = spark.createDataFrame([(r["lang"], min(1.0, (4 * each + 20) / max(r["n"], 1))) for r in counts], "lang string, rate double")
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(rates), "lang").withColumn("share", share).where("share < rate").dropDuplicates(["lang", "id", "text"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("share", "id", "text"))
    drawn = drawn.withColumn("turn", turn).where(F.col("turn") <= each)

    def make():
        present = Presence()
        return lambda texts: [[present(t).astype(np.int32).tobytes() for t in texts]]

    sets = per_text(drawn, "lang", "text", make, "grams binary").collect()
    order = sorted((r["lang"], bytes(r["grams"])) for r in sets)
    return solve([(lang, np.frombuffer(grams, np.int32)) for lang, grams in order], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score and known (the share of n-grams that landmarks have) for every row."""
    make = model.scorer if model else lambda: lambda texts: [[UND] * len(texts), *([0.0] * len(texts) for _ in range(2))]
    return per_text(docs, id_col, text_col, make, "lang_pred string, score double, known double")


def accepted(docs: DataFrame, model: Model | None, *, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs without the rows that are `und` or known to less than `least`, by default the model's own bound; rows pass
    through untouched. Without a model nothing can be told of any text, and all rows stay."""
    if model is None:
        return docs
    importable(docs.sparkSession)
    make, bound = model.scorer, model.least if least is None else least

    def run(batches):
        import pyarrow as pa

        forget()
        score = make()
        for batch in (x for b in batches for x in portions(b, b.schema.get_field_index(text_col))):
            langs, _, known = score(batch.column(batch.schema.get_field_index(text_col)).to_pylist())
            yield batch.filter(pa.array([lang != UND and k >= bound for lang, k in zip(langs, known, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = predict(docs, fit(spark, docs))
    return rows.select("doc_id", (crc_fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
