"""Removal of repeated passages, by level-wise doubling of windows of words.

At the first level windows of `start` words are counted; those that occur once are dropped. The others are extended to
twice the length and counted again, level by level, until no candidates survive or the target length is reached, which
is where removal is decided (the last step may be less than a doubling). Before the target only anchors are looked at:
of the level's windows in each window of the target length the one with the least hash. Equal target windows have equal
anchors, so none is lost, and about two in (target - length + 2) words are an anchor.

Each word that lies in a window of target length whose words also start earlier (smaller id, or same document and
earlier start) goes. Of texts that are the same as a whole only the first is taken apart; the others repeat it from
end to end. Hashes have 64 bits while candidates are sought. Where removal is decided they have 128: two hashes of
words, each with its own hash of runs, so that neither can be told from the other.

Defined results: null text has no words. Null ids come last in the order. Rows that share an id come in the order of
a hash of their texts; rows that share id and text are one document said twice and get the same result, so neither is
earlier. An empty table gives no rows. Columns other than id and text aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import hashing
from lodestone.llm.common import Workspace, per_text, small_enough

TARGET, START = 20, 5


def lengths(start: int, target: int) -> list[int]:
    """The lengths before the target: start, doubled again and again."""
    if not 0 < start < target:
        raise ValueError("start must be positive and less than target")
    out = [start]
    while 2 * out[-1] < target:
        out.append(2 * out[-1])
    return out


def anchors(hashes: np.ndarray, start: int, target: int) -> np.ndarray:
    """Where the least start-word window of each target-word window begins; the first of equals."""
    span = target - start + 1
    if len(hashes) < span:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(np.arange(len(view)) + view.argmin(1))


def anchor_of(hashes: np.ndarray, start: int, target: int) -> np.ndarray:
    """The anchor of each target-word window."""
    view = np.lib.stride_tricks.sliding_window_view(hashes, target - start + 1)
    return np.arange(len(view)) + view.argmin(1)


def covered(size: int, starts: np.ndarray, target: int) -> np.ndarray:
    """Which of `size` words lie in a window that begins at one of starts."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + target, size), -1)
    return np.cumsum(steps[:-1]) > 0


def _joined(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()



def repeated(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, start: int = START, space: Workspace | None = None):
    """(rows, cuts): all rows as id, s, sha, later, n_words, plain, and for each taken-apart text with something to
    remove its id, s, n_removed, kept_sha256 and spans of words to keep."""
    space = space or Workspace(spark, "passages")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("s"))
    rows = space.table(base.select("id", "s", F.unhex(F.sha2("text", 256)).alias("sha")), "rows")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("s").alias("s"))
    firsts = rows.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = firsts.where("n > 1").select(F.col("sha").alias("_sha"), "first")
    later = rows.join(small_enough(copies), F.col("sha") == F.col("_sha")).where(F.col("first") != order)
    later = space.table(later.select("id", "s", "sha").distinct(), "later")
    gone = later.select(F.col("id").alias("_id"), F.col("s").alias("_s"))
    single = base.join(small_enough(gone), F.col("id").eqNullSafe(F.col("_id")) & (F.col("s") == F.col("_s")), "left_anti")

    def first_level():
        def run(texts: list) -> list:
            out: list[list] = [[], [], [], []]
            for t in texts:
                raw = t.encode("utf-8", "replace")
                words = raw.split()
                h = hashing.runs(hashing.words(raw), start)
                at = anchors(h, start, target)
                for col, v in zip(out, (len(words), _joined(words), at, h[at].view(np.int64)), strict=True):
                    col.append(v)
            return out

        return run

    keyed = single.select(F.struct("id", "s").alias("k"), "text")
    level = per_text(keyed, "k", "text", first_level, "n_words long, plain string, at array<long>, h array<long>")
    level = space.table(level.select("k.*", "n_words", "plain", F.arrays_zip("at", "h").alias("a")), "level")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("s") == F.col("_s"))
    heads = level.join(rows.select(F.col("id").alias("_id"), F.col("s").alias("_s"), "sha"), same).select("sha", "n_words", "plain").dropDuplicates(["sha"])
    heads = space.table(heads, "heads")

    def surviving(marks: DataFrame, texts: DataFrame, length: int) -> DataFrame:
        """id, s, text and alive, the places of this length's anchors that occur again; texts without any are left out.
        What occurs again and what is alive are tables of their own, and not aggregates that a join takes as they lie:
        so the planner can split what a passage that very many documents share makes of one key."""
        marks = marks.select("id", "s", F.explode("a").alias("a")).select("id", "s", "a.at", "a.h")
        twice = space.table(marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), f"twice-{length}")
        alive = marks.join(twice, "h").groupBy("id", "s").agg(F.collect_list("at").alias("alive"))
        alive = space.table(alive.select(F.col("id").alias("_id"), F.col("s").alias("_s"), "alive"), f"alive-{length}")
        candidates = texts.select("id", "s", "text").join(small_enough(alive.select("_id", "_s")), same, "left_semi")
        out = space.table(candidates.join(alive, same).select("id", "s", "text", "alive"), f"texts-{length}")
        space.drop(f"twice-{length}", f"alive-{length}")
        return out

    def doubled(length: int, to: int):
        """Windows of target length whose anchor of this length is alive, as anchors of the next length or as windows."""

        def make():
            def run(found: list) -> list:
                out: list[list] = [[], [], []]
                for row in found:
                    raw = row["text"].encode("utf-8", "replace")
                    words = hashing.words(raw)
                    at = np.flatnonzero(np.isin(anchor_of(hashing.runs(words, length), length, target), row["alive"]))
                    if to < target:
                        g = hashing.runs(words, to)
                        at = np.unique(anchor_of(g, to, target)[at])
                        h = np.zeros(len(g), np.uint64)
                    else:
                        g, h = hashing.runs(words, to), hashing.runs(hashing.words(raw, 1), to, 22)
                    for col, v in zip(out, (at, g[at].view(np.int64), h[at].view(np.int64)), strict=True):
                        col.append(v)
                return out

            return run

        return make

    def longer(texts: DataFrame, length: int, to: int) -> DataFrame:
        keyed = texts.select(F.struct("id", "s").alias("k"), F.struct("text", "alive").alias("x"))
        return per_text(keyed, "k", "x", doubled(length, to), "at array<long>, g array<long>, h array<long>")

    levels = lengths(start, target)
    texts = surviving(level, single, start)
    space.drop("level")
    for length, to in zip(levels, levels[1:], strict=False):
        if texts.isEmpty():
            break
        marks = longer(texts, length, to).select("k.*", F.arrays_zip("at", F.col("g").alias("h")).alias("a"))
        texts = surviving(space.table(marks, f"level-{to}"), texts, to)
        space.drop(f"level-{to}", f"texts-{length}")
        levels = [x for x in levels if x >= to]
    windows = space.table(longer(texts, levels[0], target).select("k.*", F.arrays_zip("at", "g", "h").alias("w")), "windows")
    windows = windows.select("id", "s", F.explode("w").alias("w")).select("id", "s", "w.at", "w.g", "w.h")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "s", "at")
    earliest = windows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("earliest")).where("n > 1").select("g", "h", "earliest")
    earliest = space.table(earliest, "earliest")
    cut = windows.join(earliest, ["g", "h"]).where(F.col("earliest") != place).groupBy("id", "s").agg(F.collect_set("at").alias("at"))
    cut = space.table(cut.select(F.col("id").alias("_id"), F.col("s").alias("_s"), "at"), "cut")
    space.drop("windows", "earliest")

    def kept():
        def run(rows: list) -> list:
            out: list[list] = [[], [], []]
            for row in rows:
                words = row["text"].encode("utf-8", "replace").split()
                gone = covered(len(words), np.array(row["at"], np.int64), target)
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for col, v in zip(out, (int(gone.sum()), _joined(left), b" ".join(left).decode()), strict=True):
                    col.append(v)
            return out

        return run

    keyed = texts.join(cut, same).select(F.struct("id", "s").alias("k"), F.struct("text", "at").alias("x"))
    cuts = per_text(keyed, "k", "x", kept, "n_removed long, kept_sha256 string, kept string").select("k.*", "n_removed", "kept_sha256", "kept")
    cuts = space.table(cuts.dropDuplicates(["id", "s"]), "cuts")
    repeats = later.select(F.col("id").alias("_id"), F.col("s").alias("_s"), F.lit(True).alias("later"))
    whole = rows.join(repeats, same, "left").select("id", "s", "sha", F.coalesce("later", F.lit(False)).alias("later"))
    return whole.join(heads, "sha"), cuts


def without_repeats(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET, **options) -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256, kept (the words left, joined by a space; null
    if nothing goes from the text or everything does)."""
    rows, cuts = repeated(spark, docs, id_col=id_col, text_col=text_col, target=target, **options)
    cuts = cuts.select(F.col("id").alias("_id"), F.col("s").alias("_s"), "n_removed", "kept_sha256", "kept")
    out = rows.join(cuts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("s") == F.col("_s")), "left")
    whole = F.col("later") & (F.col("n_words") >= target)
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "plain")).alias("kept_sha256"), "kept",
    )


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


ORACLE_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)
), repeats AS MATERIALIZED (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS turn FROM windows) WHERE turn > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM repeats
), lists AS (
  SELECT doc_id, list(i) AS spots FROM gone GROUP BY 1
), marks AS (
  SELECT doc_id, w, coalesce(spots, []) AS spots FROM docs LEFT JOIN lists USING (doc_id)
), left_over AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs) ANTI JOIN gone USING (doc_id, i)
), texts AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM left_over GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(spots)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM marks LEFT JOIN texts USING (doc_id)
"""
