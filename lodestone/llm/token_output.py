"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits. Level k of a segment has chunk k of every id that reaches that far, one bit
per chunk that tells whether the id goes on, and a rank directory: the number of such bits before every 512th. The
chunk of id i at the next level stands at the rank of its bit, so any id is read with one look per level and no
block is decoded.

A table of segments, in ascending order of document ids, is the file format: Parquet rows, not compressed, with the
segment's codes, its documents and the running counts that place it. Documents are dealt to partitions by range of id,
then of a hash of the text, then of the row, so no order is gathered anywhere and no id is more than a task can take;
they are tokenized there. tokens_at() looks tokens up by their place in the whole table.

Defined results: null text counts as empty and has the end id alone. Null ids come first. Rows with the same id
follow each other, in order of a hash of their texts. An empty table gives no rows. A text longer than a segment gets
a segment for itself. Columns other than id and text aren't looked at.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, forget, held, importable, portions, small_enough

CHUNK, SPAN = 8, 512
MAGIC = b"DAC1"
#: Ids after which a segment ends.
SEGMENT = 1 << 19
#: How the pre-tokenizer whose units can go to the model describes itself, and its units of Latin letters,
#: ASCII digits, ASCII marks other than the apostrophe (which may begin a unit with letters), and a single line's end.
SPLITS = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
UNITS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n(?=\S)")
#: Stretches of text whose ids a worker remembers, in each of two generations; and units within them.
MEMORY, INNER = 500_000, 20_000


def encode(ids: np.ndarray) -> bytes:
    """ids below 2^32 as a segment."""
    values, levels = ids.astype(np.uint32), []
    while len(values):
        on = values >> CHUNK > 0
        bits = np.packbits(on, bitorder="little")
        counts = np.add.reduceat(on, np.arange(0, len(on), SPAN), dtype=np.uint32)
        rank = (np.cumsum(counts) - counts).astype("<u4")
        levels.append(struct.pack("<Q", len(values)) + rank.tobytes() + bits.tobytes() + (values & (1 << CHUNK) - 1).astype(np.uint8).tobytes())
        values = values[on] >> CHUNK
    return MAGIC + struct.pack("<QI", len(ids), len(levels)) + b"".join(levels)


class Segment:
    """Access to a segment's ids without decoding it."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a segment")
        self.size, levels = struct.unpack_from("<QI", data, 4)
        at, self.levels = 16, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            parts = []
            for dtype, count in (("<u4", -(-n // SPAN)), (np.uint8, -(-n // 8)), (np.uint8, n)):
                parts.append(np.frombuffer(data, dtype, count, at + 8 if not parts else at))
                at += parts[-1].nbytes + 8 * (len(parts) == 1)
            self.levels.append(parts)

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out, who = np.zeros(self.size, np.uint32), None
        for k, (_, bits, chunks) in enumerate(self.levels):
            on = np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)
            if who is None:
                out[:], who = chunks, np.flatnonzero(on)
            else:
                out[who] |= chunks.astype(np.uint32) << np.uint32(CHUNK * k)
                who = who[on]
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.size):
            raise IndexError("no such place")
        out, who = np.zeros(len(at), np.uint32), np.arange(len(at))
        for k, (rank, bits, chunks) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK * k)
            on = bits[at >> 3] >> (at & 7) & 1 > 0
            who, at = who[on], at[on]
            if not len(at):
                break
            at = rank[at // SPAN].astype(np.int64) + self._before(bits, at)
        return out

    @staticmethod
    def _before(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits between the last multiple of SPAN and each place."""
        first = int(at.min()) // SPAN * SPAN // 8
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(bits[first : int(at.max()) // 8 + 1]), dtype=np.int64)))
        byte = at >> 3
        part = np.bitwise_count(bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))
        return ones[byte - first] - ones[at // SPAN * SPAN // 8 - first] + part


class Known(dict):
    """The ids of what follows a space, by what follows it. Where it isn't known it is learnt; what isn't asked for
    while MEMORY others are met is forgotten."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn, self.older = learn, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.learn(text)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        self[text] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library. Its pattern always ends a token before a single space between
    two other characters, so a text's stretches between such spaces are tokenized once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        # Where texts are split by the usual pattern, the model can be asked for each unit alone. It needs no memory of
        # its own.
        usual = repr(self.tokenizer.pre_tokenizer) == SPLITS and self.tokenizer.normalizer is None
        self.ask = self.tokenizer.model.tokenize if usual else None
        if usual and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)
        self.known = Known(self._behind_space)
        self.inner: dict[str, bytes] = {}  # units that don't follow a space

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit(self, text: str, before: str = "") -> bytes:
        if not text.isascii():
            text = text.translate(_SPELLED)
        return array("I", [t.id for t in self.ask(before + text)]).tobytes()

    def _within(self, unit: str) -> bytes:
        if (ids := self.inner.get(unit)) is None:
            if len(self.inner) >= INNER:
                self.inner.clear()
            ids = self.inner[unit] = self._unit("", "Ċ") if unit == "\n" else self._unit(unit)
        return ids

    def _behind_space(self, text: str) -> bytes:
        if self.ask:
            if text.isascii() and text.isalpha():
                return array("I", [t.id for t in self.ask("Ġ" + text)]).tobytes()
            units = UNITS.findall(text)
            if units and sum(map(len, units)) == len(text):
                first = self.known.get(units[0]) or self._unit(units[0], "Ġ")
                return first + b"".join(map(self._within, units[1:])) if len(units) > 1 else first
        return array("I", self.tokenizer.encode(" " + text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(raw, np.uint32) for raw in self.raw(texts)]

    def raw(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """Each text's ids as unsigned 32-bit integers, and end behind them."""
        split = [self.stretches(t) for t in texts]
        ids = self.known.__getitem__
        return [first + b"".join(map(ids, rest)) + end for first, (_, rest) in zip(self.plain([s for s, _ in split]), split, strict=True)]

    def stretches(self, text: str) -> tuple[str, list[str]]:
        """The text up to the first single space between two other characters, and what follows each such space.
        Texts with tokens that the file adds stay whole."""
        for t in self.added:
            if t in text:
                return text, []
        parts = text.split(" ")
        if not (_GAP.search(text) or text[:1].isspace() or text[-1:].isspace()):
            return parts[0], parts[1:]
        out = [parts[0]]
        for p in parts[1:]:
            last = out[-1]
            if p and last and not p[0].isspace() and not last[-1].isspace():
                out.append(p)
            else:
                out[-1] = f"{last} {p}"
        if len(out) > 1 and out[-1][-1:].isspace():  # it could join with what comes next where many are tokenized
            return " ".join(out), []
        return out[0], out[1:]


_GAP = re.compile(r"\s\s")
# Characters that stand for the bytes of Latin letters.
_BYTES = [chr(i) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174 else "" for i in range(256)]
_BYTES = [c or chr(256 + _BYTES[:i].count("")) for i, c in enumerate(_BYTES)]
_SPELLED = {i: "".join(_BYTES[x] for x in chr(i).encode()) for i in range(0xC0, 0x250)}


def encoder(path: str) -> Encoder:
    """One to a worker process: what it remembers outlives a task."""
    return held(("encoder", path), lambda: Encoder(path))


def write(spark: SparkSession, docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write docs' ids as segments to path and return that table: part, seg, docs (ids), sizes, codes, base."""
    importable(spark)
    kind = docs.schema[id_col].dataType
    shape = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seg", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("total", T.LongType()), T.StructField("codes", T.BinaryType())])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("id").asc_nulls_first(), F.col("_h"), F.col("_row")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        forget(but=("encoder", tokenizer))
        texts_of, arrow, part = encoder(tokenizer), to_arrow_schema(shape), TaskContext.get().partitionId()
        end = np.uint32(end_id).tobytes()
        ids, owners, total, seg = [], [], 0, 0

        def done():
            values = ([part], [seg], [owners], [[len(x) // 4 for x in ids]], [total], [encode(np.frombuffer(b"".join(ids), np.uint32))])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for some in portions(batch, 1):
                for owner, raw in zip(some.column(0).to_pylist(), texts_of.raw(some.column(1).to_pylist(), end), strict=True):
                    n_ids = len(raw) // 4
                    if ids and total + n_ids > SEGMENT:
                        yield done()
                        ids, owners, total, seg = [], [], 0, seg + 1
                    ids.append(raw)
                    owners.append(owner)
                    total += n_ids
        if ids:
            yield done()

    rows.mapInArrow(run, shape).write.option("compression", "uncompressed").parquet(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments at path with base, the number of ids in all segments before. Partitions are placed first, then
    the segments of each."""
    table = spark.read.parquet(path)
    slim = table.select("part", "seg", "total")
    parts = slim.groupBy("part").agg(F.sum("total").alias("ids"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("before"))
    inside = slim.select("part", "seg", F.coalesce(F.sum("total").over(earlier(Window.partitionBy("part").orderBy("seg"))), F.lit(0)).alias("inside"))
    bases = inside.join(parts, "part").select("part", "seg", (F.col("before") + F.col("inside")).alias("base"))
    return table.join(small_enough(bases), ["part", "seg"])  # else the codes would be shuffled with them


def per_document(table: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read from the segments' codes."""
    kind = table.schema["docs"].dataType.elementType
    shape = T.StructType([T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in ("start", "n_tokens", "ids_crc32"))])
    importable(table.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(shape)
        for batch in batches:
            docs, sizes, codes, base = batch.columns
            for i in range(batch.num_rows):
                each = sizes[i].values.to_numpy()
                ends = np.cumsum(each)
                raw = memoryview(Segment(memoryview(codes[i].as_buffer())).all().astype("<u4", copy=False)).cast("B")
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * (ends - each)).tolist(), (4 * ends).tolist(), strict=True)]
                cols = (docs[i].values, ends - each + base[i].as_py(), each, crcs)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return table.select("docs", "sizes", "codes", "base").mapInArrow(run, shape)


def tokens_at(table: DataFrame, places: DataFrame, place_col: str = "place") -> DataFrame:
    """place_col and id for each distinct place in the whole table, counted from 0; places beyond it, and nulls, give
    no row. A segment's places are looked up together, without decoding it."""
    importable(table.sparkSession)
    wanted = places.select(F.col(place_col).cast("long").alias("place")).where("place >= 0").distinct()
    # Segments and places meet in the stretches of SEGMENT places that a segment touches.
    bounds = table.select("part", "seg", "base", "total", F.explode(F.sequence(F.floor(F.col("base") / SEGMENT), F.floor((F.col("base") + F.col("total") - 1) / SEGMENT))).alias("near"))
    met = wanted.withColumn("near", F.floor(F.col("place") / SEGMENT)).join(bounds, "near").where((F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.col("total")))
    asked = met.groupBy("part", "seg").agg(F.collect_list(F.col("place") - F.col("base")).alias("at"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes, at, base = batch.columns
            for i in range(batch.num_rows):
                spots = at[i].values.to_numpy()
                ids = Segment(memoryview(codes[i].as_buffer())).get(spots)
                yield pa.RecordBatch.from_arrays([pa.array(spots + base[i].as_py(), pa.int64()), pa.array(ids.astype(np.int64))], names=[place_col, "id"])

    found = table.select("part", "seg", "codes", "base").join(asked, ["part", "seg"]).select("codes", "at", "base")
    return found.mapInArrow(run, f"`{place_col}` long, id long")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{Workspace(spark, 'tokens').path}/segments"
    return per_document(write(spark, docs, path, tokenizer=public_tokenizers.path("byte_bpe_50k.json")))
