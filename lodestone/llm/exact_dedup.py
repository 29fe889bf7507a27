"""Exact deduplication over disk-backed stream state.

A slim table (digest, stable identifier, content locator) of all rows runs through a streaming aggregation whose
RocksDB state has one entry per digest and never expires: the number of rows seen, and the identifier and locator
of the row that stays. A later call can go on from the same state. The state then answers, for every row, whether
its digest was hit; on hits the row's full text is compared with the text that the locator names.

Defined results: null text counts as empty, and all empty texts are one group. Of equal texts the row with the
largest id stays; a null id is smaller than any other; among rows that also share the id, the last in (file, row)
order stays. An empty table gives no rows. Further columns of the input are carried by drop_duplicates alone and
cannot clash, since the work is done on the text, the id and the row's address only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_ROWS, Workspace, address, located, small_enough, unfolded, whole_rows

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store, however small, takes megabytes of disk
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
#: Copies compared by one task at most, on average; the kept row of a larger group is sent to several tasks.
COPIES_A_TASK = 256


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _slim(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    at = address()
    return docs.select(digest(_text(text_col)).alias("d"), F.col(id_col).alias("id"), at["f"].alias("f"), at["r"].alias("r"))


def absorb(spark: SparkSession, slim: DataFrame, path: str, state: str, bytes_per_trigger: int) -> DataFrame:
    """Feed the rows at path into the keyed state at state; return the whole state: d, n, keep(id, f, r)."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(slim.schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(path)
        seen = stream.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "f", "r")).alias("keep"))
        query = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        state_rows = spark.read.format("statestore").load(state)
        n, keep = (f"value.`{x}`" for x in state_rows.select("value.*").columns)
        return state_rows.select(F.col("key.d").alias("d"), F.col(n).alias("n"), F.col(keep).alias("keep"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _differing(spark: SparkSession, docs: DataFrame, held: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests under which some row's bytes differ from the kept row's. Only texts with a hit are shuffled while the
    digests that were hit are few; a large group's kept text goes to as many tasks as it has COPIES_A_TASK copies."""
    at = address()
    hit = held.where("n > 1").select("d", "n", "keep")
    texts = docs.select(digest(_text(text_col)).alias("d"), _text(text_col).alias("text"), at["f"].alias("f"), at["r"].alias("r"))
    texts = texts.join(small_enough(hit, BROADCAST_ROWS), "d")
    parts = F.ceil(F.col("n") / COPIES_A_TASK).cast("int")
    stays = (F.col("f") == F.col("keep.f")) & (F.col("r") == F.col("keep.r"))
    kept = texts.where(stays).select("d", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rest = texts.where(~stays).select("d", "text", F.pmod(F.xxhash64("f", "r"), parts).cast("int").alias("part"))
    return rest.join(kept, ["d", "part"]).where(F.col("text") != F.col("kept_text")).select("d").distinct()


def decisions(
    spark: SparkSession,
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_bytes,
    bytes_per_trigger: int = 8 << 30,
    space: Workspace | None = None,
) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256, and its address f, r."""
    space = space or Workspace(spark, "exact")
    docs = located(docs, space)
    slim = space.table(_slim(docs, id_col, text_col, digest), "slim")
    held = space.table(absorb(spark, slim, f"{space.path}/slim", f"{space.path}/state", bytes_per_trigger), "held")
    wrong = space.table(_differing(spark, docs, held, text_col, digest), "wrong")
    out = slim.join(held, "d")
    if digest is sha256_bytes:
        out = out.withColumn("sha", F.lower(F.hex("d")))
    else:
        at = address()
        out = out.join(docs.select(at["f"].alias("f"), at["r"].alias("r"), F.sha2(_text(text_col), 256).alias("sha")), ["f", "r"])
    if not wrong.isEmpty():
        # Different bytes under one digest: there the whole text is the key.
        at = address()
        rows = docs.select(digest(_text(text_col)).alias("d"), _text(text_col).alias("t"), F.col(id_col).alias("id"), at["f"].alias("f"), at["r"].alias("r")).join(wrong, "d", "left_semi")
        by_text = rows.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "f", "r")).alias("keep"))
        mended = rows.join(by_text, "t").select("id", "f", "r", "n", "keep", F.sha2("t", 256).alias("sha"))
        out = out.join(wrong, "d", "left_anti").select(mended.columns).unionByName(mended)
    stays = (F.col("f") == F.col("keep.f")) & (F.col("r") == F.col("keep.r"))
    return out.select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"), "f", "r"
    )


def drop_duplicates(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are not kept; columns and their order stay."""
    space = Workspace(spark, "exact")
    docs = located(docs, space)
    gone = space.table(decisions(spark, docs, space=space, **options).where("NOT kept").select(F.struct("f", "r").alias("gone")), "gone")
    rows = whole_rows(docs, address().alias("at"))
    return unfolded(rows.join(gone, F.col("at") == F.col("gone"), "left_anti"), docs)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decisions(spark, docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
