"""Postings counted by numpy from portions of texts, as they are read: they are never kept, nor shuffled.

A document has hundreds of postings, so rows of them are several times the input. Here a portion's postings are arrays
that go as soon as they have been added up or scored. Tokens are those of functions.text, with its own expressions for
whatever depends on Unicode's tables."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import SEPARATORS, STOPWORDS
from lodestone.workers import importable

#: Documents and bytes of a portion at most (or one document), and tokens that a task remembers.
DOCUMENTS, BYTES, MOST = 384, 2 << 20, 300_000
SINGLE = 0x1FFFFF  # stands before the one character of a text that has no pair
_LOWER = bytes(32 if i < 128 and chr(i) in SEPARATORS else i + 32 if 65 <= i <= 90 else i for i in range(256))
_PURE, _NO_DIGIT = b"abcdefghijklmnopqrstuvwxyz0123456789. ", bytes(i for i in range(256) if not 48 <= i <= 57)
_SIGNS = re.compile(f"[{''.join(c for c in SEPARATORS if not c.isascii() and not c.isspace())}]")
_HIGH = bytes(range(128, 256))
_SEPARATOR = np.zeros(0x110000, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_ONE = np.uint64(SINGLE << 21)
# Stopwords that spelling can give, and the first character that they have.
_STOP = np.array([(ord(w[0]) if w[1:] else SINGLE) << 21 | ord(w[-1]) for w in STOPWORDS if len(w) < 3], np.uint64)
_LEAST = min(map(ord, "".join(STOPWORDS)))


def packed(texts: DataFrame, text: Column, one_row_each: bool) -> DataFrame:
    """doc_id and rows, the texts of that id: body, and where it isn't all ASCII its lower case and its numbers."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit("。"), F.lit(" "))  # a separator like a space
    rows = texts.select("doc_id", body.alias("body"))
    other = F.octet_length("body") != F.length("body")
    row = F.struct("body", F.when(other, F.lower("body")).alias("low"), F.when(other, F.regexp_extract_all("body", F.lit(r"(?U)\d+"), F.lit(0))).alias("numbers"))
    return rows.select("doc_id", F.array(row).alias("rows")) if one_row_each else rows.groupBy("doc_id").agg(F.collect_list(row).alias("rows"))


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    rows = batch.column(1)
    size = np.asarray(pa.compute.binary_length(rows.flatten().field(0)), np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(np.asarray(pa.compute.list_value_length(rows)))]
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(at + DOCUMENTS, max(at + 1, int(np.searchsorted(ends, before + BYTES, "right"))))
        yield batch.slice(at, stop - at)
        at = stop


class _Ids(dict):
    """Numbers of tokens, in the order in which they are met."""

    def __missing__(self, token: str) -> int:
        self[token] = found = len(self)
        return found


class Counts:
    """Counts the tokens of portions; ids are the numbers that it gives to tokens."""

    def __init__(self, char_ngram: bool):
        self.char_ngram = char_ngram
        self.clear()

    def clear(self) -> None:
        self.ids = _Ids()
        self.codes, self.code_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @staticmethod
    def _words(body: str, low: str | None, numbers: list[str] | None) -> tuple[list[str], str]:
        """The tokens that are whole words or numbers, and the chunks that are spelled."""
        raw = (body if low is None else low).encode().translate(_LOWER)
        odd = raw.translate(None, _PURE)
        text = raw.decode()
        words = (text if low is None else _SIGNS.sub(" ", text)).split()  # no stopword is ASCII
        spelled = ""
        if odd:
            if odd.translate(None, _HIGH):
                whole = [w.isascii() and not w.encode().translate(None, _PURE) for w in words]
            else:
                whole = list(map(str.isascii, words))
            spelled = " ".join([w for w, x in zip(words, whole, strict=True) if not x])
            words = list(compress(words, whole))
        if low is not None:
            words += ["#" + d for d in numbers]
        elif raw.translate(None, _NO_DIGIT):
            words += ["#" + d for d in re.findall("[0-9]+", text)]
        return words, spelled

    def _named(self, code: np.ndarray) -> np.ndarray:
        """Numbers of tokens of one or two characters."""
        at = np.minimum(np.searchsorted(self.codes, code), max(0, len(self.codes) - 1))
        new = self.codes[at] != code if len(self.codes) else np.ones(len(code), bool)
        if not new.any():
            return self.code_ids[at]
        codes = np.unique(code[new])
        ids = [self.ids[(chr(c >> 21) if c >> 21 != SINGLE else "") + chr(c & SINGLE)] for c in codes.tolist()]
        codes, ids = np.concatenate((self.codes, codes)), np.concatenate((self.code_ids, np.array(ids, np.int64)))
        order = np.argsort(codes)
        self.codes, self.code_ids = codes[order], ids[order]
        return self.code_ids[np.searchsorted(self.codes, code)]

    def _keyed(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of document and token, and how often they are there, from those of document and characters."""
        key, n = _counted(key)
        return (key >> np.uint64(42)).astype(np.int64) << 32 | self._named(key & np.uint64((1 << 42) - 1)), n

    def _grams(self, owner: np.ndarray, bodies: list[str]) -> tuple[np.ndarray, np.ndarray]:
        char, text = _characters(bodies)
        kept = ~_SEPARATOR[char]
        char, text = char[kept], text[kept]
        inner = text[1:] == text[:-1]
        alone = np.flatnonzero(np.bincount(text, minlength=len(bodies))[text] == 1)
        doc = owner.astype(np.uint64)[text] << np.uint64(42)
        return self._keyed(np.concatenate((doc[1:][inner] | _pairs(char)[inner], doc[alone] | _ONE | char[alone])))

    def _spelled(self, owner: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each character of the chunks, and each pair."""
        char, text = _characters(chunks)
        doc, kept = owner.astype(np.uint64)[text] << np.uint64(42), char != 32
        inner = kept[1:] & kept[:-1] & (text[1:] == text[:-1])
        single, pair = _ONE | char[kept], _pairs(char)[inner]
        key = np.concatenate((doc[kept] | single, doc[1:][inner] | pair))
        if len(char) and char.max() >= _LEAST:
            key = key[~np.isin(np.concatenate((single, pair)), _STOP)]
        return self._keyed(key)

    def __call__(self, rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document (its place), token, n and wn of a portion, in order of document and token."""
        owner = np.repeat(np.arange(len(rows)), np.asarray(pa.compute.list_value_length(rows)))
        bodies, lows, numbers = (rows.flatten().field(i).to_pylist() for i in range(3))
        words, spelled = [], []
        for x in zip(bodies, lows, numbers, strict=True):
            w, chunks = self._words(*x)
            words.append(w)
            spelled.append(chunks)
        size = [len(x) for x in words]
        token = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(words)), np.int64, sum(size))
        found = [_counted(np.repeat(owner, size) << 32 | token), self._spelled(owner, spelled)]
        word = sum(len(k) for k, _ in found)
        if self.char_ngram:
            found.append(self._grams(owner, bodies))
        key, n = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key)
        wn = np.where(order < word, n[order], 0)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
        if len(first):
            key, n, wn = key[first], np.add.reduceat(n, first), np.add.reduceat(wn, first)
        return key >> 32, key & 0xFFFFFFFF, n, wn


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters, and which text each is in."""
    char = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return char, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _pairs(char: np.ndarray) -> np.ndarray:
    return char[:-1] << np.uint64(21) | char[1:]


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
    return key[first], np.diff(np.append(first, len(key)))


def frequencies(rows: DataFrame, char_ngram: bool) -> DataFrame:
    """t, df, wdf, said of packed texts: in how many documents a token is, in how many as a word, and how often as a word."""
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = Counts(char_ngram), np.zeros((3, 0), np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.ids), pa.string()), *map(pa.array, sums)], ["t", "df", "wdf", "said"])

        for batch in batches:
            for part in portions(batch):
                _, token, _, wn = counts(part.column(1))
                if (size := len(counts.ids)) > sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, size + size // 4 - sums.shape[1])))
                for i, x in enumerate((None, wn > 0, wn)):
                    sums[i] += np.bincount(token, x, sums.shape[1]).astype(np.int64)
                if size > MOST:
                    sums = sums[:, :size]
                    yield done()
                    counts.clear()
                    sums = np.zeros((3, 0), np.int64)
        sums = sums[:, : len(counts.ids)]
        yield done()

    found = rows.mapInArrow(run, "t string, df long, wdf long, said long")
    return found.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("df", "wdf", "said")])


def hashed(token: str) -> bytes:
    return hashlib.md5(token.encode(), usedforsecurity=False).digest()[:8]


def table(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """64-bit hashes, in order, and df of the tokens that more than one document has; a token that isn't among them is
    in one document. None if there are more than `most`, or if two have the same hash."""
    several = found.where("df > 1")
    if several.count() > most:
        return None
    half = lambda at: F.conv(F.substring(F.md5("t"), at, 8), 16, 10).cast("long")
    rows = several.select(F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("h"), F.col("df").cast("int")).toArrow()
    hashes = rows["h"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    return None if (hashes[1:] == hashes[:-1]).any() else (hashes, rows["df"].to_numpy()[order].astype(np.int32))


class Postings:
    """Counts with the idf of each token and its number among some, if it is one of them."""

    def __init__(self, char_ngram: bool, hashes: np.ndarray, df: np.ndarray, n_docs: int, min_df: int = 1, numbers: dict[str, int] | None = None):
        self.counts, self.hashes, self.df, self.n_docs, self.min_df = Counts(char_ngram), hashes, df, n_docs, min_df
        self.numbers = numbers or {}
        self.idf, self.number = np.zeros(0), np.zeros(0, np.int64)

    def __call__(self, rows: pa.ListArray):
        """Document, number, n and wn of the postings whose tokens have one; and dl and norm by document, null for those
        that have no token at all."""
        if len(self.counts.ids) > MOST:
            self.counts.clear()
            self.idf, self.number = np.zeros(0), np.zeros(0, np.int64)
        doc, token, n, wn = self.counts(rows)
        if len(self.counts.ids) > len(self.idf):
            new = list(self.counts.ids)[len(self.idf) :]
            own = np.frombuffer(b"".join(map(hashed, new)), ">u8").astype(np.uint64)
            df = np.ones(len(new))
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
                df = np.where(self.hashes[at] == own, self.df[at], 1).astype(float)
            idf = np.where(df >= self.min_df, np.log((1.0 + self.n_docs) / (1.0 + df)) + 1.0, 0.0)
            self.idf = np.concatenate((self.idf, idf))
            self.number = np.concatenate((self.number, np.array([self.numbers.get(t, -1) for t in new], np.int64)))
        size = len(rows)
        norm = np.sqrt(np.bincount(doc, ((1.0 + np.log(n)) * self.idf[token]) ** 2, size))
        dl, any_token = np.bincount(doc, wn, size), np.bincount(doc, minlength=size) > 0
        own = self.number[token]
        asked = own >= 0
        return doc[asked], own[asked], n[asked], wn[asked], dl, norm, any_token


def documents(rows: DataFrame, char_ngram: bool, known: tuple[np.ndarray, np.ndarray], n_docs: int, min_df: int) -> DataFrame:
    """doc_id, dl and norm of packed texts that have tokens."""
    importable(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings = Postings(char_ngram, *sent.value, n_docs, min_df)
        for batch in batches:
            for part in portions(batch):
                *_, dl, norm, kept = postings(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(kept)), pa.array(dl[kept].astype(np.int64)), pa.array(norm[kept])], ["doc_id", "dl", "norm"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, dl long, norm double")
