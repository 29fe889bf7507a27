"""ISO media containers as columns.

walk() reads the nested boxes of a container and decodes its sample tables (stts, stss, stsc, stsz or stz2, stco or
co64) and the runs of its fragments (moof) into one row per track: codec, duration and the byte ranges of keyframes.
Payloads are never decoded. store() writes
bytes as a container with one track of raw 8 x 8 frames of 8-bit grey samples, so any multiple of 64 bytes is kept
without loss.

Defined results: null content gives no tracks; a container that is cut short or broken gives the tracks that could
be read and an error. What a container claims is held against its size before memory is taken for it, and boxes
nest DEPTH deep at most. Box sizes of 0 (to the end) and 1 (64 bits) are understood. Without a stss box every sample is
a keyframe. A null text counts as empty; equal texts give equal bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import per_text

FRAME, TIMESCALE, KEY_EVERY, FRAMES_A_CHUNK = 64, 25, 16, 32
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta")
#: Boxes within boxes at most.
DEPTH = 16
BROKEN = (ValueError, KeyError, struct.error, IndexError, OverflowError)
TRACKS = "array<struct<codec:string,timescale:long,duration:long,samples:long,keyframes:array<struct<start:long,size:long>>>>"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def store(payload: bytes) -> bytes:
    """A container whose only track has payload, of a positive multiple of 64 bytes, as raw frames."""
    frames = len(payload) // FRAME
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    chunks = -(-frames // FRAMES_A_CHUNK)
    last = frames - (chunks - 1) * FRAMES_A_CHUNK
    runs = [(1, FRAMES_A_CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last < FRAMES_A_CHUNK)
    keys = np.arange(1, frames + 1, KEY_EVERY, dtype=">u4")

    def moov(first: int) -> bytes:
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
        offsets = first + np.arange(chunks, dtype=np.uint64) * FRAME * FRAMES_A_CHUNK
        table = _box(
            b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, frames, 1)), _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, n, 1) for a, n in runs)), _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
        )
        media = _box(
            b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(13)),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3), media)
        head = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", head, track)

    large = len(payload) + 16 >= 1 << 32
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if large else struct.pack(">I4s", len(payload) + 8, b"mdat")
    first = len(ftyp) + len(moov(0)) + len(mdat)
    return b"".join((ftyp, moov(first), mdat, payload))


def boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """kind, start and end of the content, of the boxes from at to end."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        stop = end if size == 0 else at + size
        if stop < at + head or stop > end:
            raise ValueError(f"box {kind!r} at {at} runs out of its parent")
        yield kind, at + head, stop
        at = stop
    if at != end:
        raise ValueError(f"{end - at} stray bytes at {at}")


def _leaves(data: memoryview, at: int, end: int, depth: int = 0) -> dict[bytes, tuple[int, int]]:
    """The boxes below, without those that only nest; the first of a kind counts."""
    if depth > DEPTH:
        raise ValueError("boxes nest too deep")
    found: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in boxes(data, at, end):
        for k, v in (_leaves(data, a, b, depth + 1) if kind in NESTED else {kind: (a, b)}).items():
            found.setdefault(k, v)
    return found


def _sizes(data: memoryview, leaf: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """The size of each sample, by stsz or the compact stz2."""
    a, b = leaf[b"stz2" if b"stz2" in leaf and b"stsz" not in leaf else b"stsz"]
    word, n = struct.unpack_from(">II", data, a + 4)
    if b"stsz" in leaf and word:
        if word * n > len(data):
            raise ValueError("samples are larger than the file")
        return np.full(n, word, np.int64)
    bits = 32 if b"stsz" in leaf else word & 0xFF
    if bits not in (4, 8, 16, 32):
        raise ValueError(f"sample sizes of {bits} bits")
    if n * bits > 8 * (b - a - 12):
        raise ValueError("sample sizes run out of their box")
    if bits == 4:
        packed = np.frombuffer(data[a + 12 : b], np.uint8, count=-(-n // 2))
        return np.stack((packed >> 4, packed & 15), 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data[a + 12 : b], f">u{bits // 8}", count=n).astype(np.int64) if n else np.empty(0, np.int64)


def _track(data: memoryview, leaf: dict[bytes, tuple[int, int]]) -> dict:
    def table(kind: bytes, skip: int, dtype: str, width: int) -> np.ndarray:
        """The rows of a table whose count stands before them."""
        a, b = leaf[kind]
        n = struct.unpack_from(">I", data, a + skip - 4)[0]
        values = np.frombuffer(data[a + skip : b], dtype, count=n * width) if n else np.empty(0, dtype)
        return values.reshape(n, width).astype(np.int64)

    a, _ = leaf[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
    codec = bytes(data[leaf[b"stsd"][0] + 12 : leaf[b"stsd"][0] + 16]).decode("latin-1")
    sizes = _sizes(data, leaf)
    n = len(sizes)
    chunks = table(b"co64", 8, ">u8", 1)[:, 0] if b"co64" in leaf else table(b"stco", 8, ">u4", 1)[:, 0]
    runs = table(b"stsc", 8, ">u4", 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1)) if len(runs) else np.empty(0, np.int64)
    if spans.sum() != len(chunks) or (len(spans) and (spans.min() < 0 or runs[0, 0] != 1)) or (spans * runs[:, 1]).sum() != n:
        raise ValueError("the sample tables disagree")
    each = np.repeat(runs[:, 1], spans)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = np.cumsum(each) - each
    starts = begins - np.repeat(begins[np.minimum(first, max(n - 1, 0))] if n else first, each) + np.repeat(chunks, each)
    keys = table(b"stss", 8, ">u4", 1)[:, 0] - 1 if b"stss" in leaf else np.arange(n)
    times = table(b"stts", 8, ">u4", 2)
    if times[:, 0].sum() != n:
        raise ValueError("stts doesn't cover the samples")
    if len(keys) and (keys.min() < 0 or keys.max() >= n):
        raise ValueError("stss names samples that aren't there")
    number = struct.unpack_from(">I", data, leaf[b"tkhd"][0] + (20 if data[leaf[b"tkhd"][0]] == 1 else 12))[0] if b"tkhd" in leaf else 0
    return {"id": number, "codec": codec, "timescale": timescale, "duration": duration or int((times[:, 0] * times[:, 1]).sum()), "samples": n, "starts": starts, "sizes": sizes, "keys": keys}


def _defaults(data: memoryview, at: int, end: int) -> dict[int, tuple[int, int, int]]:
    """Of an mvex box: duration, size and flags of samples, by track."""
    found = {}
    for kind, a, _ in boxes(data, at, end):
        if kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">IIIII", data, a + 4)
            found[track] = duration, size, flags
    return found


def _run(data: memoryview, a: int, b: int, default: tuple[int, int, int]) -> tuple[int | None, np.ndarray]:
    """Of a trun box: where its data begin, if it says so, and duration, size and flags of each sample."""
    flags, n = struct.unpack_from(">II", data, a)
    at = a + 8
    offset = struct.unpack_from(">i", data, at)[0] if flags & 1 else None
    at += 4 * (flags & 1)
    first = struct.unpack_from(">I", data, at)[0] if flags & 4 else None
    at += flags & 4
    given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if 4 * n * len(given) > b - at or n > len(data):
        raise ValueError("a run has more samples than room for them")
    rows = np.tile(np.array(default, np.int64), (n, 1))
    values = np.frombuffer(data[at:b], ">u4", count=n * len(given)).reshape(n, len(given)) if n and given else np.empty((n, 0))
    for k, bit in enumerate(given):
        if bit < 0x800:
            rows[:, (0x100, 0x200, 0x400).index(bit)] = values[:, k]
    if first is not None and n:
        rows[0, 2] = first
    return offset, rows


def _fragment(data: memoryview, at: int, end: int, head: int, tracks: dict[int, dict], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Add the samples of a moof box, which begins at head, to the tracks."""
    for kind, a, b in boxes(data, at, end):
        if kind != b"traf":
            continue
        inner = list(boxes(data, a, b))
        start = next(x for k, x, _ in inner if k == b"tfhd")
        flags, number = struct.unpack_from(">II", data, start)
        track, place = tracks[number], start + 8
        base, default = head, list(defaults.get(number, (0, 0, 0)))
        if flags & 1:
            base = struct.unpack_from(">Q", data, place)[0]
            place += 8
        place += 4 * bool(flags & 2)
        for k, bit in enumerate((8, 0x10, 0x20)):
            if flags & bit:
                default[k] = struct.unpack_from(">I", data, place)[0]
                place += 4
        following = base
        for k, x, y in inner:
            if k != b"trun":
                continue
            offset, rows = _run(data, x, y, tuple(default))
            begin = following if offset is None else base + offset
            ends = begin + np.cumsum(rows[:, 1])
            n = track["samples"]
            track["starts"] = np.append(track["starts"], ends - rows[:, 1])
            track["sizes"] = np.append(track["sizes"], rows[:, 1])
            track["keys"] = np.append(track["keys"], n + np.flatnonzero(rows[:, 2] & 0x10000 == 0))
            track["samples"], track["lasts"] = n + len(rows), track.get("lasts", 0) + int(rows[:, 0].sum())
            following = int(ends[-1]) if len(rows) else begin


def walk(content: bytes | None) -> tuple[list[dict], str | None]:
    """The tracks that could be read, with where their samples lie, and what went wrong first. A broken track leaves
    the others, and so does a broken fragment; samples that lie beyond the end are told."""
    tracks: list[dict] = []
    errors: list[str] = []
    data = memoryview(content or b"")
    defaults: dict[int, tuple[int, int, int]] = {}

    def attempt(what, *args) -> None:
        try:
            what(*args)
        except (*BROKEN, StopIteration) as e:
            errors.append(f"{type(e).__name__}: {e}")

    def movie(a: int, b: int) -> None:
        for k, c, d in boxes(data, a, b):
            if k == b"trak":
                attempt(lambda c=c, d=d: tracks.append(_track(data, _leaves(data, c, d))))
            elif k == b"mvex":
                attempt(lambda c=c, d=d: defaults.update(_defaults(data, c, d)))

    def file() -> None:
        for kind, a, b in boxes(data, 0, len(data)):
            if kind == b"moov":
                attempt(movie, a, b)
            elif kind == b"moof":
                attempt(_fragment, data, a, b, a - 8, {t["id"]: t for t in tracks}, defaults)

    attempt(file)
    for t in tracks:
        t["duration"] = t["duration"] or t.get("lasts", 0)
        if len(t["starts"]) and (t["starts"].min() < 0 or (t["starts"] + t["sizes"]).max() > len(data)):
            errors.append("ValueError: samples lie beyond the end")
    return tracks, errors[0] if errors else None


def samples(content: bytes, track: dict) -> bytes:
    """A track's bytes, sample after sample; samples that follow each other are read at once."""
    starts, sizes = track["starts"], track["sizes"]
    if not len(starts):
        return b""
    breaks = np.flatnonzero(starts[1:] != starts[:-1] + sizes[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(starts)) - 1
    return b"".join(content[a:b] for a, b in zip(starts[firsts].tolist(), (starts[lasts] + sizes[lasts]).tolist(), strict=True))


def described(table: DataFrame, *, id_col: str, content_col: str) -> DataFrame:
    """id_col, tracks and error for each container in content_col."""

    def make():
        def read(contents: list) -> list:
            found = [walk(c) for c in contents]
            rows = [[{k: int(t[k]) if k != "codec" else t[k] for k in ("codec", "timescale", "duration", "samples")} | {"keyframes": [{"start": int(t["starts"][i]), "size": int(t["sizes"][i])} for i in t["keys"]]} for t in tracks] for tracks, _ in found]
            return [rows, [error for _, error in found]]

        return read

    return per_text(table, id_col, content_col, make, f"tracks {TRACKS}, error string")


def contained(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes and media: each text's container."""

    def make():
        def write(texts: list) -> list:
            raw = [(t or "").encode() for t in texts]
            return [list(map(len, raw)), [store(padded(r)) for r in raw]]

        return write

    return per_text(docs, id_col, text_col, make, "n_bytes long, media binary")


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % FRAME or (0 if raw else FRAME))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = contained(docs).select("doc_id", F.struct("n_bytes", "media").alias("x"))

    def make():
        def features(rows: list) -> list:
            out: list[list] = [[] for _ in range(7)]
            for row in rows:
                media = row["media"]
                (track,), error = walk(media)
                payload = samples(media, track)
                key_at, key_size = track["starts"][track["keys"]], track["sizes"][track["keys"]]
                ranges = hashlib.sha256(np.stack((key_at, key_size), 1).astype("<i8").tobytes()).hexdigest()[:16]
                said = f"codec={track['codec'].strip()};duration={track['duration']}/{track['timescale']};samples={track['samples']};keyframes={len(key_at)};first={key_at[0]}+{key_size[0]};last={key_at[-1]}+{key_size[-1]};ranges={ranges};error={error or ''}"
                for col, v in zip(out, (row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), said), strict=True):
                    col.append(v)
            return out

        return features

    return per_text(media, "doc_id", "x", make, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
