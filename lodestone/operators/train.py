"""Softmax regression and a one-hidden-layer network, trained by Adam on sparse features.

Each group of a grouped map is one training run (a fold, a grid cell, a model), so runs go in parallel and a run is
the work of one task: it must fit in an executor. Beyond that, at_scale() trains a multinomial regression on all
executors; its loss is the same, its optimizer and so its optimum are not.

Adam is lazy: a coordinate whose gradient is 0 keeps its moments, and L2 applies only to coordinates that the batch
touched; biases have none.
"""

from __future__ import annotations

import pickle
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.workers import importable

# Seeds of the initial weights and of the two models' shuffles.
INIT, SHUFFLE = 7, {"logreg": 11, "mlp": 13}


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.params, self.rate, self.b1, self.b2, self.eps, self.t = params, rate, b1, b2, eps, 0
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in range(2))

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        up1, up2 = 1 - self.b1**self.t, 1 - self.b2**self.t
        for p, g, m, v in zip(self.params, gradients, self.m, self.v, strict=True):
            # Whole arrays, written where the gradient isn't 0: gathering what is touched would cost more.
            at = g != 0
            np.copyto(m, self.b1 * m + (1 - self.b1) * g, where=at)
            np.copyto(v, self.b2 * v + (1 - self.b2) * g * g, where=at)
            np.subtract(p, self.rate * (m / up1) / (np.sqrt(v / up2) + self.eps), out=p, where=at)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gaussian(rng: random.Random, rows: int, cols: int, sigma: float) -> np.ndarray:
    return np.array([rng.gauss(0, sigma) for _ in range(rows * cols)]).reshape(rows, cols)


class Net:
    """hidden=0: softmax regression; else a hidden ReLU layer of that width."""

    def __init__(self, dim: int, classes: int, hidden: int = 0, rate: float = 0.05, l2: float = 1e-3, epochs: int = 100, batch: int = 32, seed: int = INIT):
        rng = random.Random(seed)
        if hidden:
            self.params = [gaussian(rng, hidden, dim, (2 / dim) ** 0.5), np.zeros(hidden), gaussian(rng, classes, hidden, (2 / hidden) ** 0.5), np.zeros(classes)]
        else:
            self.params = [gaussian(rng, classes, dim, 0.01), np.zeros(classes)]
        self.dim, self.hidden, self.rate, self.l2, self.epochs, self.batch = dim, hidden, rate, l2, epochs, batch
        self.history: list[dict] = []

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.hidden:
            return x, softmax(x @ self.params[0].T + self.params[1])
        h = np.maximum(x @ self.params[0].T + self.params[1], 0)
        return h, softmax(h @ self.params[2].T + self.params[3])

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        h, p = self._forward(x)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum()
        d = p
        d[np.arange(len(y)), y] -= 1
        n = len(y)
        said = (x != 0).any(0)
        if not self.hidden:
            w = d.T @ x / n + self.l2 * self.params[0] * said
            return [w, d.sum(0) / n], loss
        back = (d @ self.params[2]) * (h > 0)
        touched = (back != 0).T.astype(float) @ (x != 0) > 0
        return [back.T @ x / n + self.l2 * self.params[0] * touched, back.sum(0) / n, d.T @ h / n + self.l2 * self.params[2], d.sum(0) / n], loss

    def fit(self, x: np.ndarray, y: np.ndarray, x_val: np.ndarray | None = None, y_val: np.ndarray | None = None) -> Net:
        if x.shape[1] != self.dim:
            raise ValueError(f"the model has {self.dim} features, the examples {x.shape[1]}")
        adam, order = Adam(self.params, self.rate), list(range(len(y)))
        rng = random.Random(SHUFFLE["mlp" if self.hidden else "logreg"])
        for epoch in range(1, self.epochs + 1):
            rng.shuffle(order)
            total = 0.0
            for at in range(0, len(order), self.batch):
                part = order[at : at + self.batch]
                gradients, loss = self._gradients(x[part], y[part])
                adam.step(gradients)
                total += loss
            if epoch == 1 or epoch % 5 == 0:
                seen = {"epoch": epoch, "loss": round(total / max(len(y), 1), 4)}
                if x_val is not None and len(x_val):
                    seen["val_acc"] = round(self.accuracy(x_val, y_val), 4)
                self.history.append(seen)
        return self

    def accuracy(self, x: np.ndarray, y: np.ndarray) -> float:
        return float((self.probabilities(x).argmax(1) == y).sum() / max(len(y), 1)) if len(y) else 0.0


class Vectorizer:
    """TF-IDF of token lists, fitted on the training part of a run; the vocabulary is sorted."""

    def __init__(self, token_lists: list[list[str]]):
        df: dict[str, int] = {}
        for tokens in token_lists:
            for t in set(tokens):
                df[t] = df.get(t, 0) + 1
        self.place = {t: i for i, t in enumerate(sorted(df))}
        n = len(token_lists)
        self.idf = np.array([np.log((1 + n) / (1 + df[t])) + 1 for t in self.place])

    def __call__(self, token_lists: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(token_lists), len(self.place)))
        for row, tokens in zip(x, token_lists, strict=True):
            for t in tokens:
                if (i := self.place.get(t)) is not None:
                    row[i] += 1
        said = x > 0
        x[said] = 1 + np.log(x[said])
        x *= self.idf
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(norm <= 1e-12, 1, norm)


def fitted(examples: DataFrame, settings: DataFrame, classes: int) -> DataFrame:
    """examples: run, doc_id, tokens, label_id; settings: run, model, hidden, rate, l2, epochs. Per run: train_acc and
    net, the pickled vectorizer and net."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.iloc[0]
        pdf = pdf.sort_values("doc_id")
        vectorize = Vectorizer([list(t) for t in pdf.tokens])
        x, y = vectorize([list(t) for t in pdf.tokens]), pdf.label_id.to_numpy(int)
        net = Net(x.shape[1], classes, hidden=int(s.hidden), rate=float(s.rate), l2=float(s.l2), epochs=int(s.epochs)).fit(x, y)
        return pd.DataFrame([{"run": s.run, "model": s.model, "train_acc": net.accuracy(x, y), "net": pickle.dumps((vectorize, net))}])

    importable(examples.sparkSession)
    # A number of partitions of its own: left to adaptive execution, such small rows would all be one task's.
    joined = examples.join(F.broadcast(settings), "run").repartition(4 * max(1, settings.count()), "run")
    return joined.groupBy("run").applyInPandas(train, "run string, model string, train_acc double, net binary")


def judged(held: DataFrame, nets: dict[int, list[tuple[str, bytes]]]) -> DataFrame:
    """run, val_acc over every row of held (part, tokens, label_id); nets: by part, what fitted() gave for the runs that
    hold it out. The runs of a part share their training rows, and so their vectorizer."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {part: [(run, *pickle.loads(net)) for run, net in some] for part, some in nets.items()}
        right: dict[str, int] = {}
        seen: dict[str, int] = {}
        for pdf in parts:
            for part, rows in pdf.groupby("part"):
                for at in range(0, len(rows), 64):  # dense rows are wide
                    some = rows.iloc[at : at + 64]
                    x, y = known[part][0][1]([list(t) for t in some.tokens]), some.label_id.to_numpy(int)
                    for run, _, net in known[part]:
                        right[run] = right.get(run, 0) + int((net.probabilities(x).argmax(1) == y).sum())
                        seen[run] = seen.get(run, 0) + len(y)
        yield pd.DataFrame({"run": list(seen), "right": [right[r] for r in seen], "n": list(seen.values())}).astype({"run": str, "right": "int64", "n": "int64"})

    importable(held.sparkSession)
    rows = held.select("part", "tokens", "label_id").mapInPandas(score, "run string, right long, n long")
    return rows.groupBy("run").agg((F.sum("right") / F.sum("n")).alias("val_acc"))


def batches(texts: DataFrame, net: Net, vectorize: Vectorizer) -> DataFrame:
    """doc_id, label_id, p of a trained model, for doc_id and tokens."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 64):  # dense rows are wide
                some = pdf.iloc[at : at + 64]
                p = net.probabilities(vectorize([list(t) for t in some.tokens]))
                yield pd.DataFrame({"doc_id": np.repeat(some.doc_id.to_numpy(), p.shape[1]), "label_id": np.tile(np.arange(p.shape[1], dtype=np.int32), len(p)), "p": p.ravel()})

    importable(texts.sparkSession)
    return texts.select("doc_id", "tokens").mapInPandas(score, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, label_id int, p double")


def at_scale(examples: DataFrame, l2: float = 1e-3, features: int = 1 << 18):
    """A fitted pipeline for doc_id, tokens and label_id: hashed TF-IDF and multinomial regression on all executors."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    stages = [HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="x")]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="x", labelCol="label_id", family="multinomial", regParam=l2)]).fit(examples)
