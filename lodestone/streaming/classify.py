"""The classifier and the tokenizer on a stream. Both are stateless: a row's result needs nothing but the row and
the fitted tables, so no watermark is needed and late rows are rows like any others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokenize
from lodestone.operators.intent import Keywords, action, predictions


def tokens(stream: DataFrame, text: str = "text") -> DataFrame:
    return stream.withColumn("tokens", tokenize(text))


def classify_into(stream: DataFrame, model: Keywords, path: str, checkpoint: str, *, key: str = "doc_id", text: str = "text"):
    """Start a query that writes each micro-batch's predictions to path; a batch that is replayed replaces its own."""
    rows = stream.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        found = predictions(model.probabilities(batch), model.labels)
        found.withColumn("action", action(F.col("confidence"), F.col("margin"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
