"""Training, cross-validation, tuning and classification of texts: what the service's verbs return."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import char_ngrams, tokenize
from lodestone.operators import intent, train


def featured(texts: DataFrame) -> DataFrame:
    """texts with tokens: words and character pairs."""
    return texts.withColumn("tokens", F.concat(tokenize("text"), char_ngrams("text")))


@dataclass
class Classifier:
    """Keyword, softmax and network models of one training set. The training set is gathered on the driver, as the
    parity trainers need it in one place: `most` bounds it."""

    examples: DataFrame  # doc_id, text, label_id
    labels: DataFrame  # label_id, label
    quick: bool = False
    most: int = 20_000

    def __post_init__(self):
        self.keywords = intent.Keywords.fit(self.examples, self.labels)
        rows = featured(self.examples).select("doc_id", "label_id", "tokens").orderBy("doc_id").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"more than {self.most} examples: use train.at_scale")
        self.vectorize = train.Vectorizer([r["tokens"] for r in rows])
        x, y = self.vectorize([r["tokens"] for r in rows]), train.np.array([r["label_id"] for r in rows], int)
        classes = self.labels.count()
        self.nets = {
            "logreg": train.Net(x.shape[1], classes, epochs=40 if self.quick else 100).fit(x, y),
            "mlp": train.Net(x.shape[1], classes, hidden=16, epochs=40 if self.quick else 80).fit(x, y),
        }

    def probabilities(self, texts: DataFrame, model: str) -> DataFrame:
        return self.keywords.probabilities(texts) if model == "keyword" else train.batches(featured(texts), self.nets[model], self.vectorize)

    def classify(self, texts: DataFrame) -> DataFrame:
        """doc_id, model, label, confidence, margin, top3, and action by the softmax model."""
        rows = None
        for model in ("keyword", "logreg", "mlp"):
            one = intent.predictions(self.probabilities(texts, model), self.labels).withColumn("model", F.lit(model))
            rows = one if rows is None else rows.unionByName(one)
        act = rows.where("model = 'logreg'").select("doc_id", intent.action(F.col("confidence"), F.col("margin")).alias("action"))
        return rows.join(act, "doc_id")

    def report(self, texts: DataFrame) -> DataFrame:
        """One row of accuracy figures per model, for texts with label_id."""
        out = None
        for model in ("keyword", "logreg", "mlp"):
            judged = intent.predictions(self.probabilities(texts, model), self.labels).join(texts.select("doc_id", "label_id"), "doc_id")
            row = intent.summary(judged, self.labels).withColumn("model", F.lit(model))
            out = row if out is None else out.unionByName(row)
        return out


def _settings(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, "run string, model string, hidden int, rate double, l2 double, epochs int")


def _lowest(rows: DataFrame, most: int | None) -> DataFrame:
    """The rows whose ids hash lowest, `most` of them; all if it is None."""
    return rows if most is None else rows.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)


def _evaluated(fit: DataFrame, settings: DataFrame, held: DataFrame, part_of: Callable[[str], int], classes: int) -> DataFrame:
    """run, model, train_acc, val_acc. Fits go in parallel; held (part, text, label_id) is scored whole, on all executors."""
    fits = train.fitted(fit, settings, classes).collect()
    nets: dict[int, list] = {}
    for r in fits:
        nets.setdefault(part_of(r["run"]), []).append((r["run"], bytes(r["net"])))
    known = fit.sparkSession.createDataFrame([(r["run"], r["model"], r["train_acc"]) for r in fits], "run string, model string, train_acc double")
    return known.join(train.judged(featured(held), nets), "run", "left").na.fill(0.0, ["val_acc"])


def cross_validate(examples: DataFrame, classes: int, k: int = 4, seed: int = 3, epochs: int = 40, sample: int | None = None) -> DataFrame:
    """model, mean, std (of the population), folds: accuracies on each fold in turn. Each is fitted on the other folds,
    or on `sample` rows of them, and judged on the whole fold."""
    rows = examples.join(intent.folds(examples, k, seed).select("doc_id", F.col("fold").cast("int").alias("part")), "doc_id")
    models = {"logreg": 0, "mlp": 16}
    settings = _settings(examples, [(f"{m}-{f}", m, h, 0.05, 1e-3, epochs) for m, h in models.items() for f in range(k)])
    runs = [_lowest(rows.where(F.col("part") != f), sample).withColumn("run", F.explode(F.array(*[F.lit(f"{m}-{f}") for m in models]))) for f in range(k)]
    fit = featured(reduce(DataFrame.unionByName, runs)).select("run", "doc_id", "tokens", "label_id")
    done = _evaluated(fit, settings, rows, lambda run: int(run.split("-")[1]), classes)
    folds = F.transform(F.sort_array(F.collect_list(F.struct("run", "val_acc"))), lambda x: x["val_acc"])
    return done.groupBy("model").agg(F.avg("val_acc").alias("mean"), F.stddev_pop("val_acc").alias("std"), folds.alias("folds"))


def grid_search(examples: DataFrame, held_out: DataFrame, classes: int, epochs: tuple[int, int] = (100, 80), sample: int | None = None) -> DataFrame:
    """run, model, train_acc, val_acc for a small grid. Cells are fitted on examples, or on `sample` of them, and judged
    on all of held_out."""
    cells = [(f"logreg lr={r} l2={z}", "logreg", 0, r, z, epochs[0]) for r in (0.05, 0.1) for z in (1e-4, 1e-3)]
    cells += [(f"mlp h={h} l2={z}", "mlp", h, 0.05, z, epochs[1]) for h in (16, 32, 64) for z in (1e-3, 1e-2)]
    settings = _settings(examples, cells)
    fit = featured(_lowest(examples, sample)).select("doc_id", "tokens", "label_id").crossJoin(F.broadcast(settings.select("run")))
    done = _evaluated(fit, settings, held_out.withColumn("part", F.lit(0)), lambda run: 0, classes)
    return done.select("run", "model", "train_acc", "val_acc")
