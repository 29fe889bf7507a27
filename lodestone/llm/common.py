"""What the operators share: tables in the cluster's shared folder, worker paths and row addresses."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.workers import importable

#: A side is broadcast only when a count has shown it to have at most this many narrow rows; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are maximal runs of bytes other than these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows handled at once by Python at most, and their bytes unless one row has more.
TEXTS, BYTES = 512, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset, a folder of this
    machine will do if all work is done here; on a cluster that would lose data, and is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Workspace:
    """Tables that one run writes to the shared folder. They go when the driver ends, since results may read them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and read it back: its lineage ends here, and a lost executor loses nothing. The shuffle
        files that made it go at once."""
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.parquet(f"{self.path}/{name}")
        finally:
            self.spark.conf.unset(CLEAN_UP) if before is None else self.spark.conf.set(CLEAN_UP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read again."""
        for name in names:
            _remove(self.spark, f"{self.path}/{name}")


def located(docs: DataFrame, space: Workspace) -> DataFrame:
    """docs, readable with a _metadata column: itself if it comes from files, else a copy in the shared folder."""
    with contextlib.suppress(AnalysisException):
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return docs
    return space.table(docs, "located")


def address() -> Column:
    """Which file, and which row of it."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint only if it has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """docs' rows as one column, row, beside the given columns: no name of theirs can clash with one of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unfolded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows as docs has them."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 is held out of all training. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def table_at(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_bytes(column: Any) -> np.ndarray:
    """About how many bytes each value of an Arrow column takes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = column.type
    if pa.types.is_struct(kind):
        return sum((_row_bytes(column.field(i)) for i in range(kind.num_fields)), np.zeros(len(column), np.int64))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), 8)


def portions(batch: Any, column: int, rows: int = TEXTS, size: int = BYTES) -> Iterator:
    """The batch in slices of at most so many rows, and so many bytes of that column unless one row has more."""
    ends = np.cumsum(_row_bytes(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


_held: dict[Any, Any] = {}


def _return_memory() -> None:
    """Give what this worker process no longer uses back to the system: workers are idle most of their lives."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What one operator keeps in a worker process between tasks. Only the last operator's is kept."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]


def forget(but: Any = None) -> None:
    """Let go of what other operators have kept in this worker process."""
    for key in [k for k in _held if k != but]:
        del _held[key]
    _return_memory()


class Memo(dict):
    """What a worker remembers by text, in two generations of at most `most` entries: what isn't asked for while a
    generation fills is forgotten with the next. Entries of the older one are met by old()."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def old(self, keys: list) -> list:
        """Bring back the keys that the older generation has; the others are returned."""
        if len(self) + len(keys) > self.most:
            self.older = dict(self)
            self.clear()
        found = {k: v for k in keys if (v := self.older.get(k)) is not None}
        self.update(found)
        return [k for k in keys if k not in found] if found else keys


def per_text(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list], list]], fields: str, keeps: Any = None) -> DataFrame:
    """id_col and, for each row, the columns that make()'s function returns for a list of texts. Python gets portions
    that are bounded in rows and bytes. keeps: the key under which make() has something held."""
    import pyarrow as pa

    spark = docs.sparkSession
    importable(spark)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL(fields).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        forget(but=keeps)
        f, shape = make(), to_arrow_schema(out)
        for batch in batches:
            for part in portions(batch, 1):
                cols = [part.column(0).cast(shape.field(0).type), *(pa.array(c, shape.field(i).type) for i, c in enumerate(f(part.column(1).to_pylist()), 1))]
                yield pa.RecordBatch.from_arrays(cols, schema=shape)
        del f
        _return_memory()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)
