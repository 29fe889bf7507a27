"""SentencePiece encoding and decoding with batched numpy Viterbi.

Texts are cut into stretches that no piece crosses: between two characters that stand side by side in no piece.
Many stretches lie end to end in one array and advance together: all places descend the trie of the pieces at once,
a character a turn, and for each end position, counted from its stretch's beginning, the best way to reach it is kept
with a backpointer.

For unigram models the best way has the greatest sum of piece scores. For BPE models, whose merges aren't the best
sum of anything, a step scores 1 or nothing: whether the piece and the one before it would stay two pieces if
their text were merged by rank. Exactly one last piece of any prefix passes, so the path is the merge result itself.
Whether two pieces stay apart is read off the merges that made them, for many pairs at once, and remembered.

A character that no piece has becomes its byte pieces, or the unknown piece if the model has none. Decoding joins
the pieces' bytes. Models whose normalizer rewrites characters are refused.

Defined results: null text counts as empty and has no pieces. A literal U+2581 is the same as a space, as in the
format, so it comes back as one. Rows may repeat and ids be null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import hashing
from lodestone.llm.common import Memo, held, per_text

SPACE = "▁"
U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Words that a worker remembers, in each of two generations; code points that advance together, and of texts that are
#: cut into words together, unless one stretch or text has more.
MEMORY, TOGETHER, LETTERS = 100_000, 1 << 16, 1 << 18
NEVER = 1 << 40


class Table:
    """Values (0 or more) by 64-bit keys: the keys' products with an odd number, sorted, and where each beginning of
    them first stands."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        spread = keys.astype(np.uint64) * U(BASE)
        order = np.argsort(spread)
        bits = max(8, len(keys).bit_length() + 2)
        self.shift = U(64 - bits)
        self.first = np.searchsorted(spread, np.arange(1 << bits, dtype=np.uint64) << self.shift, sorter=order).astype(np.int32)
        self.spread, self.values = np.append(spread[order], U((1 << 64) - 1)), np.append(values[order], -1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key (uint64), -1 where there is none."""
        spread = keys * U(BASE)
        at = self.first[(spread >> self.shift).view(np.int64)]
        there = self.spread[at]
        less = np.flatnonzero(there < spread)
        while len(less):
            at[less] += 1
            there[less] = self.spread[at[less]]
            less = less[there[less] < spread[less]]
        return np.where(there == spread, self.values[at], -1)


class Pieces:
    """A model's pieces, ready for look-ups."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        self.prefix = rules.add_dummy_prefix
        self.bpe = model.trainer_spec.model_type == proto.TrainerSpec.BPE
        if not self.bpe and model.trainer_spec.model_type != proto.TrainerSpec.UNIGRAM:
            raise ValueError("only unigram and BPE models are supported")
        self.texts = [p.piece for p in model.pieces]
        kind = [p.type for p in model.pieces]
        K = proto.ModelProto.SentencePiece
        self.unknown = kind.index(K.UNKNOWN)
        self.bytes = {int(t[3:-1], 16): i for i, t in enumerate(self.texts) if kind[i] == K.BYTE}
        self.raw = [bytes([int(t[3:-1], 16)]) if k == K.BYTE else b" \xe2\x81\x87 " if k == K.UNKNOWN else b"" if k == K.CONTROL else t.replace(SPACE, " ").encode() for t, k in zip(self.texts, kind, strict=True)]
        self.score = np.array([p.score for p in model.pieces])
        usable = [i for i, k in enumerate(kind) if k in (K.NORMAL, K.USER_DEFINED)]
        self.space = next((i for i in usable if self.texts[i] == SPACE), None)
        self.runs = sorted(((len(self.texts[i]), i) for i in usable if set(self.texts[i]) == {SPACE}), reverse=True)
        inner = [i for i in usable if set(self.texts[i]) != {SPACE} or self.texts[i] == SPACE] if self.bpe else usable
        if self.bpe:
            inner = self._merges(inner)
        below, last = {}, []  # the trie: places by place and character, and where each piece ends
        for i in inner:
            at = 0
            for c in self.texts[i]:
                at = below.setdefault(at << 21 | ord(c), len(below) + 1)
            last.append(at)
        self.below = Table(np.array(list(below), np.uint64), np.array(list(below.values()), np.int32))
        self.piece = np.full(len(below) + 1, -1, np.int32)
        self.piece[last] = inner
        pairs = np.unique(np.array([ord(a) << 32 | ord(b) for i in inner for a, b in zip(self.texts[i], self.texts[i][1:], strict=False)], np.uint64))
        self.adjacent = Table(pairs, np.zeros(len(pairs), np.int32))
        self.memo_key, self.memo = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        if not self.bpe:
            self.lowest = self.score[usable].min() - 10

    def _merges(self, usable: list[int]) -> list[int]:
        """Find which two pieces each piece is last merged from; return the pieces that merging reaches."""
        at = {self.texts[i]: i for i in usable}
        size = len(self.texts)
        rank = np.full(size, NEVER, np.int64)
        for place, i in enumerate(sorted((i for i in usable if len(self.texts[i]) > 1), key=lambda i: (-self.score[i], i))):
            rank[i] = place
        for i in usable:
            if len(self.texts[i]) == 1:
                rank[i] = -1
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        reached, keys, ranks = [], [], []
        for i in usable:
            text = self.texts[i]
            parts = list(text)
            last = None
            while len(parts) > 1:
                best, where = NEVER, -1
                for k in range(len(parts) - 1):
                    j = at.get(parts[k] + parts[k + 1], -1)
                    if j >= 0 and rank[j] < best:
                        best, where = rank[j], k
                if where < 0:
                    break
                last = parts[where], parts[where + 1]
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
            if len(parts) == 1:
                reached.append(i)
                if last:
                    left[i], right[i] = at.get(last[0], -1), at.get(last[1], -1)
            for k in range(1, len(text)):
                a, b = at.get(text[:k], -1), at.get(text[k:], -1)
                if a >= 0 and b >= 0:
                    keys.append(a << 32 | b)
                    ranks.append(rank[i])
        if any(c not in at for i in reached for c in self.texts[i]):
            raise ValueError("a piece has a character that isn't a piece")
        self.rank, self.left, self.right = rank, left, right
        self.pairs = Table(np.array(keys, np.uint64), np.array(ranks, np.int64))
        return reached

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of neighbours: whether merging leaves them as they are."""
        key = a << 32 | b
        slot = (key.view(np.uint64) * U(BASE) >> U(44)).astype(np.int64)
        out = self.memo[slot]
        if len(miss := np.flatnonzero(self.memo_key[slot] != key)):
            out[miss] = self._apart(a[miss], b[miss])
            self.memo_key[slot[miss]], self.memo[slot[miss]] = key[miss], out[miss]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges of both sides, latest first: had the pair at the seam merged before the merge undone?"""
        a, b = a.copy(), b.copy()
        out, who = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), NEVER, np.int64)
        while len(who):
            first = self.pairs((a << 32 | b).view(np.uint64))
            merged = (first >= 0) & (first < limit)
            out[who[merged]] = False
            go = ~merged & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            who, a, b = who[go], a[go], b[go]
            undo = self.rank[a] > self.rank[b]  # of equal merges the left one came first
            # What is undone on the right came after an equal merge at the seam, which lies to its left.
            limit = np.where(undo, self.rank[a], self.rank[b] + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _within(self, points: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the points that end within their stretch (left: the points from here to its end): where each
        begins, its id and its width; narrow ones first."""
        who, at, width, found = np.arange(len(points), dtype=np.int32), np.zeros(len(points), np.int32), 0, []
        while len(who):
            at = self.below(at.astype(np.uint64) << U(21) | points[who + width])
            width += 1
            go = np.flatnonzero(at >= 0)
            who, at = who[go], at[go]
            ids = self.piece[at]
            has = np.flatnonzero(ids >= 0)
            found.append((who[has], ids[has], np.full(len(has), width, np.int32)))
            go = np.flatnonzero(left[who] > width)
            who, at = who[go], at[go]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def viterbi(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For stretches of these sizes, end to end in points: whether a piece of the best way ends at each point, and
        that piece. None ends where nothing is known."""
        n = len(points)
        starts = np.cumsum(sizes) - sizes
        place = np.arange(n) - np.repeat(starts, sizes)
        begin, ids, width = self._within(points, np.repeat(sizes, sizes) - place)
        step = place[begin] + width
        longest = int(sizes.max())
        order = np.argsort(step.astype(np.uint16) if longest < 1 << 16 else step, kind="stable")
        bounds = np.cumsum(np.bincount(step, minlength=longest + 1)).tolist()
        begin, ids, end, free = begin[order], ids[order].astype(np.int64), (begin + width - 1)[order], (width == step)[order]
        whole = (np.cumsum(np.bincount(step[width == step], minlength=longest + 1))).tolist()
        last, back = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int32)
        if not self.bpe:
            best = np.full(n + 1, -np.inf)
            by_size = np.argsort(sizes, kind="stable")
            ending = np.searchsorted(sizes[by_size], np.arange(longest + 1)).tolist()
        for k in range(1, longest + 1):
            a, b = bounds[k - 1], bounds[k]
            if self.bpe:
                m = b - (whole[k] - whole[k - 1])  # from here on the piece is all there is, and passes
                last[end[m:b]], back[end[m:b]] = ids[m:b], begin[m:b]
                at = a + np.flatnonzero(last[end[a:m]] < 0)
                before = last[begin[at] - 1]
                some = before >= 0
                if not some.all():
                    at, before = at[some], before[some]
                at = at[self.apart(before, ids[at])]
                last[end[at]], back[end[at]] = ids[at], begin[at]
                continue
            score = np.where(free[a:b], 0.0, best[begin[a:b] - 1]) + self.score[ids[a:b]]
            at = np.lexsort((score, end[a:b]))  # of equal sums the widest piece comes last, and stays
            score, at = score[at], a + at
            best[end[at]], last[end[at]], back[end[at]] = score, ids[at], begin[at]
            ends = starts[by_size[ending[k] :]] + k - 1
            least = (best[ends - 1] if k > 1 else 0.0) + self.lowest
            stuck = ends[least > best[ends]]
            best[stuck], last[stuck], back[stuck] = (best[stuck - 1] if k > 1 else 0.0) + self.lowest, self.unknown, stuck
        mark = np.zeros(n, bool)
        at = starts + sizes - 1
        at = at[last[at] >= 0]
        while len(at):
            mark[at] = True
            at = back[at]
            at = at[place[at] > 0] - 1
        return mark, last[:n]

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all words, one after another, and where each word's begin, with the end."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points)
        cut = np.ones(n + 1, bool)  # a stretch begins here
        if n:
            cut[1:n] = self.adjacent(points[:-1] << U(32) | points[1:]) < 0
            cut[ends] = True
        starts = np.flatnonzero(cut)
        out, upto, at = [], np.zeros(n + 1, np.int64), 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + TOGETHER, "right")) - 1)
            a, b = int(starts[at]), int(starts[to])
            ids, counts = self._encoded(points[a:b], np.diff(starts[at : to + 1]))
            out.append(ids)
            upto[a + 1 : b + 1] = upto[a] + np.cumsum(counts)
            at = to
        return np.concatenate(out) if out else np.empty(0, np.int32), upto[np.append(0, ends)]

    def _encoded(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, and how many of them end at each point."""
        mark, last = self.viterbi(points, sizes)
        starts = np.cumsum(sizes) - sizes
        odd = starts[(sizes == 1) & ~mark[starts] if self.bpe else (sizes == 1) & (last[starts] == self.unknown)]
        if not len(odd):
            return last[mark].astype(np.int32), mark
        counts = mark.astype(np.int64)
        kinds, which = np.unique(points[odd], return_inverse=True)
        raw = [np.array([self.bytes[x] for x in chr(c).encode("utf-8", "replace")] if self.bytes else [self.unknown]) for c in kinds.tolist()]
        counts[odd] = np.array(list(map(len, raw)))[which]
        mark[odd] = False
        upto = np.cumsum(counts)
        ids = np.empty(upto[-1], np.int32)
        ids[upto[mark] - 1] = last[mark]
        for k, its in enumerate(raw):
            ids[(upto[odd[which == k]] - len(its))[:, None] + np.arange(len(its))] = its
        return ids, counts

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The pieces of each word."""
        ids, bounds = self.encode_flat(words)
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, path: str):
        self.pieces, self.known = Pieces(path), Memo(MEMORY)

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids, bounds = self.pieces.encode_flat([SPACE + w for w in part])
            raw, bounds = ids.tobytes(), (4 * bounds).tolist()
            for k, w in enumerate(part):
                self.known[w] = raw[bounds[k] : bounds[k + 1]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ends = np.cumsum(list(map(len, texts)))
        out, at = [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LETTERS, "right")))
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        p = self.pieces
        if not p.prefix or not p.bpe:  # words aren't apart there
            return p.encode_words([((SPACE if p.prefix else "") + t.replace(" ", SPACE)) if t else "" for t in texts])
        split = [t.replace(SPACE, " ").split(" ") if t else [] for t in texts]
        every = [w for words in split for w in words]
        known = list(map(self.known.get, every))
        if miss := [i for i, x in enumerate(known) if x is None]:
            self._learn(self.known.old(list({every[i] for i in miss})))
            for i in miss:
                known[i] = self.known[every[i]]
        out, at = [], 0
        for words in split:
            its = known[at : at + len(words)]
            at += len(words)
            if "" not in words:
                out.append(np.frombuffer(b"".join(its), np.int32))
                continue
            parts, run = [], 0
            for w, ids in zip(words, its, strict=True):
                if not w:
                    run += 1
                    continue
                if run:
                    bare = len(ids) > 4 and int.from_bytes(ids[:4], "little") == p.space
                    parts.append(self._run(run + bare))
                    ids = ids[4:] if bare else ids
                    run = 0
                parts.append(ids)
            parts.append(self._run(run))
            out.append(np.frombuffer(b"".join(parts), np.int32))
        return out

    def _run(self, n: int) -> bytes:
        """Spaces alone: their merges all rank the same, so the leftmost piece grows first."""
        ids = []
        while n:
            size, i = next((s, i) for s, i in self.pieces.runs if s <= n)
            ids += [i] * (n // size)
            n %= size
        return np.array(ids, np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        raw = self.pieces.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def codec(path: str) -> Codec:
    """One to a worker process."""
    return held(("pieces", path), lambda: Codec(path))


def encoded(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids."""
    return per_text(docs, id_col, text_col, lambda: lambda texts: [codec(path).encode([t or "" for t in texts])], "ids array<int>", ("pieces", path))


def decoded(rows: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text; null ids give null."""
    return per_text(rows, id_col, ids_col, lambda: lambda ids: [[None if x is None else codec(path).decode(np.array(x, np.int64)) for x in ids]], "text string", ("pieces", path))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids, ids_crc32 (little-endian unsigned 32 bits), exact (the ids decode to the text)."""

    def make():
        def both(texts: list) -> list:
            c = codec(path)
            texts = [t or "" for t in texts]
            ids = c.encode(texts)
            return [list(map(len, ids)), ids, [zlib.crc32(x.astype("<u4").tobytes()) for x in ids], [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]]

        return both

    return per_text(docs, id_col, text_col, make, "n_tokens long, ids array<int>, ids_crc32 long, exact boolean", ("pieces", path))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_tokens", "ids_crc32", "exact")
