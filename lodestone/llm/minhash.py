"""Near-duplicates: circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct runs of five words, by 64-bit hash. Two fixed permutations of the 64-bit numbers make
the whole signature: each element goes through the first, and coordinate k is the least value of the second after a
circular shift by k. Documents that agree on all rows of a band share a bucket; with 70 bands of 6, a pair at
similarity 0.75 shares none with probability (1 - 0.75^6)^70, one in a million.

Documents with the same set are one class, whose representative has the smallest id. In each bucket all
representatives are first compared with one, the hub; verified links are merged into components, and buckets that
still hold several components get another hub, TURNS times in all. So a group of near copies costs about as many
comparisons as it has members.

What is left are representatives of buckets with several components. Of two sets that are similar enough, the first
few elements in any common order share one: n - ceil(150 n / 175) + 1 of the smaller set, n - ceil(75 n / 100) + 1 of
the larger. The order puts first what occurs in one component alone, then what is rare. Only representatives of
different components that share such an element are compared, and of those only pairs that can be similar enough: by
their sizes, by what is left of both sets from the shared element on, and by 256 parities of the elements that several
components have. An upper bound of what two sets share is all that a pair is ever refused for, so no link is lost,
however many documents a bucket has. Comparisons intersect whole sets.

Defined results: a document without words or text has an empty set and is linked with nothing. With fewer than five
words the whole sequence is one shingle. Rows that share an id are one node of the graph, linked if any of their
texts is. Rows with a null id are linked with nothing: their component is null and they are kept. An empty table
gives no rows. Columns other than id and text aren't looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import hashing
from lodestone.llm.common import Workspace, per_text, small_enough, unfolded, whole_rows

SHINGLE, BANDS, ROWS = 5, 70, 6
SIMILAR = 75  # percent
TURNS = 2  # hubs that a bucket's representatives are compared with
MAPS = 4  # 64-bit words of parities that stand for a set when a pair is considered


def shingles(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    words = hashing.words((text or "").encode("utf-8", "replace").lower())
    if 0 < len(words) < SHINGLE:
        return hashing.mix(hashing.runs(words, len(words)) + np.uint64(len(words)), 7)
    return np.unique(hashing.runs(words, SHINGLE))


def signature(elements: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Coordinates of a set that isn't empty."""
    first, out = hashing.mix(elements, 1), np.empty(size, np.uint64)
    step = max(1, min(32, 65536 // len(elements)))
    for k in range(0, size, step):
        shift = np.arange(k, min(k + step, size), dtype=np.uint64)[:, None]
        x = first[None, :] + shift  # the second permutation, shifted
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[k : k + step] = x.min(1)
    return out


def bands(elements: np.ndarray) -> np.ndarray:
    rows = signature(elements).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = hashing.mix(key ^ rows[:, k], k)
    return key.view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), h and g (of the set), bands."""

    def make():
        def sketch(texts: list) -> list:
            out: list[list] = [[], [], [], []]
            for t in texts:
                s = shingles(t)
                h, g = (int(hashing.mix(s, by).sum(dtype=np.uint64).astype(np.int64)) for by in (2, 3))
                for col, v in zip(out, (len(s), h, g, bands(s) if len(s) else None), strict=True):
                    col.append(v)
            return out

        return sketch

    return per_text(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", make, "n long, h long, g long, bands array<long>")


def components(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """id, c: the smallest id that each end of an edge (a, b) reaches. Labels pass along edges, then to the labels of
    labels, until none changes; each round is a written table."""
    both = space.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = space.table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("c")).select("id", F.least("id", "c").alias("c")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("c").alias("near"))
        passed = labels.join(near, F.col("id") == F.col("a")).select("id", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        of = labels.select(F.col("id").alias("of"), F.col("c").alias("its"))
        jumped = passed.join(of, F.col("c") == F.col("of"), "left").select("id", F.least("c", "its").alias("c"), "was")
        now = space.table(jumped, f"{name}-{turn}")
        if now.where("c <> was").isEmpty():
            return now.select("id", "c")
        labels = now.select("id", "c")


def merged(labels: DataFrame, more: DataFrame, space: Workspace, name: str) -> DataFrame:
    """id, c: what components() would give for the edges that labels are of and more (a, b). Only labels that more
    joins are passed on, not what has one already, so a large component is gone through once, not with each addition."""
    at = lambda x: labels.select(F.col("id").alias(f"id_{x}"), F.col("c").alias(f"c_{x}"))
    ends = more.join(at("a"), F.col("a") == F.col("id_a"), "left").join(at("b"), F.col("b") == F.col("id_b"), "left")
    ends = ends.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b").distinct()
    moved = components(ends, space, name)
    to = moved.select(F.col("id").alias("was"), F.col("c").alias("now"))
    rows = labels.join(to, F.col("c") == F.col("was"), "left").select("id", F.coalesce("now", "c").alias("c"))
    return space.table(rows.unionByName(moved.join(labels, "id", "left_anti")), f"{name}-all")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """key, rep, n, c of the buckets that hold more than one component; the hub of each (top: c, rep, n) is in the last."""
    placed = shared.join(labels, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("c", "rep").alias("c"))
    keys = placed.groupBy("key").agg(F.min("c").alias("low"), F.max(F.struct("c", "rep", "n")).alias("top")).where("low < top.c").select("key", "top")
    return placed.join(keys, "key")


def _sized(n: Column, m: Column) -> Column:
    """Sets of these sizes may be similar enough."""
    return 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)


def _stars(rows: DataFrame, hub: Column, size: Column | None = None) -> DataFrame:
    """Pairs (a, b) of each row's representative with the hub, whose size may be known."""
    fits = F.lit(True) if size is None else _sized(F.col("n"), size)
    pairs = rows.where(fits & (F.col("rep") != hub)).select(F.least(hub, "rep").alias("a"), F.greatest(hub, "rep").alias("b"))
    return pairs.distinct()


def _can(overlap: Column, n: Column, m: Column) -> Column:
    """Sets of sizes n and m are similar enough if they share that many elements."""
    return (100 + SIMILAR) * overlap >= SIMILAR * (n + m)


def _across(members: DataFrame, space: Workspace) -> DataFrame:
    """Pairs (a, b) of different components that could be similar enough. members: id, s (hash of the set), n, c,
    set; an id may have several sets."""
    each = members.select("id", "s", "n", "c", F.explode("set").alias("e"))
    common = each.groupBy("e").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("k")).where("low < high").select("e", "k")
    common = space.table(common, "common")
    maps = [F.bit_xor(F.when(F.pmod(F.shiftright("e", 6), F.lit(MAPS)) == i, F.expr("shiftleft(1L, cast(e & 63 AS int))")).otherwise(F.lit(0).cast("long"))).alias(f"m{i}") for i in range(MAPS)]
    names = ["id", "n", "c", *[f"m{i}" for i in range(MAPS)]]
    rows = each.join(common, "e").groupBy("id", "s", "n", "c").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("es"), *maps)
    n, alone = F.col("n"), F.col("n") - F.size("es")
    longer = (n - F.floor((SIMILAR * n + 99) / 100) + 1 - alone).cast("int")
    shorter = n - F.floor((2 * SIMILAR * n + 99 + SIMILAR) / (100 + SIMILAR)) + 1 - alone
    rows = rows.where(longer > 0).select(*names, F.size("es").cast("long").alias("known"), shorter.alias("shorter"), F.posexplode(F.slice("es", F.lit(1), longer)).alias("at", "x"))
    rows = rows.select(*names, "known", F.col("x.e").alias("e"), (F.col("known") - F.col("at")).alias("rest"), (F.col("at") < F.col("shorter")).alias("short"))
    rows = space.table(rows, "prefixes")
    names += ["known", "rest"]
    side = lambda df, x: df.select("e", *[F.col(c).alias(f"{c}{x}") for c in names])
    a, b = side(rows.where("short"), "a"), side(rows, "b")
    # Components meet first, so that the members of one never meet each other. Of the elements that two sets share, the
    # first in order bounds how many they are: both sets' rests from there.
    group = lambda df, x: df.groupBy("e", f"c{x}").agg(F.max(f"rest{x}").alias(f"most{x}"), F.min(f"n{x}").alias(f"low{x}"))
    larger = lambda n: F.greatest(n, "lowb")
    met = group(a, "a").join(group(b, "b"), "e").where((F.col("ca") != F.col("cb")) & _can(F.least("mosta", "mostb"), F.col("lowa"), larger("lowa")))
    near = met.join(a, ["e", "ca"]).where(_can(F.least("resta", "mostb"), F.col("na"), larger("na"))).drop("mosta", "lowa", "mostb", "lowb")
    # Where parities differ, one set at least has an element that the other lacks.
    apart = sum((F.bit_count(F.col(f"m{i}a").bitwiseXOR(F.col(f"m{i}b"))) for i in range(MAPS)), F.lit(0))
    fits = _can(F.least("resta", "restb"), F.col("na"), F.col("nb")) & _can((F.col("knowna") + F.col("knownb") - apart) / 2, F.col("na"), F.col("nb"))
    pairs = near.join(b, ["e", "cb"]).where((F.col("na") <= F.col("nb")) & fits)
    return pairs.select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).where("a <> b").distinct()


def _needed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the pairs' ends."""
    ends = pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct()
    return sets.join(small_enough(ends), F.col("id") == F.col("end"), "left_semi")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    a, b = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= SIMILAR * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", space: Workspace | None = None) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    space = space or Workspace(spark, "near")
    rows = space.table(sketched(docs, id_col, text_col), "sketched")
    linkable = rows.where("n > 0 AND id IS NOT NULL")
    classes = space.table(linkable.groupBy("n", "h", "g").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")), "classes")
    spread = classes.select("rep", "n", F.explode("bands").alias("key"))
    hubs = spread.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("in_it")).where("in_it > 1").select("key", "hub")
    shared = space.table(spread.join(hubs, "key"), "shared")
    ids = shared.select(F.col("rep").alias("_id")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(small_enough(ids), F.col("id") == F.col("_id"), "left_semi")

    def make():
        return lambda texts: [[shingles(t).view(np.int64) for t in texts]]

    # Written beside the set, its size and hash aren't computed anew for each element when it is unfolded.
    sets = per_text(texts, "id", "text", make, "set array<long>").distinct()
    sets = space.table(sets.select("id", "set", F.size("set").cast("long").alias("size"), F.xxhash64("set").alias("s")), "sets")
    same = linkable.groupBy("id").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    said_twice = same.where("n0 <> n1 OR h0 <> h1").select(F.col("id").alias("rep"))
    labels = components(space.table(similar(_stars(shared, F.col("hub")), sets), "links-0"), space, "labels-0")
    for turn in range(1, TURNS):
        placed = space.table(_open(shared, labels), f"open-{turn}")
        more = space.table(similar(_stars(placed.where("c <> top.c"), F.col("top.rep"), F.col("top.n")), sets), f"links-{turn}")
        if more.isEmpty():
            break
        labels = merged(labels, more, space, f"labels-{turn}")
    left = space.table(_open(shared, labels).select(F.col("rep").alias("_id"), "c").distinct(), "left")
    members = sets.join(small_enough(left), F.col("id") == F.col("_id")).select("id", "s", F.col("size").alias("n"), "c", "set")
    pairs = space.table(_across(members, space), "pairs")
    more = space.table(similar(pairs, _needed(pairs, sets)), "links-last")
    # An id with several texts stands for each of their classes.
    doubled = linkable.join(said_twice, F.col("id") == F.col("rep"), "left_semi").join(classes.select("n", "h", "g", "rep"), ["n", "h", "g"])
    more = more.unionByName(doubled.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    final = labels if more.isEmpty() else merged(labels, more, space, "last")
    member = rows.join(classes.select("n", "h", "g", "rep"), ["n", "h", "g"], "left").join(final.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left")
    own = F.when(F.col("id").isNotNull(), F.least("id", F.coalesce("c", "rep", "id")))
    out = member.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that are not kept."""
    space = Workspace(spark, "near")
    gone = space.table(near_duplicates(spark, docs, id_col=id_col, space=space, **options).where("NOT kept").select(F.col(id_col).alias("_gone")).distinct(), "gone")
    rows = whole_rows(docs, F.col(id_col).alias("node"))
    return unfolded(rows.join(gone, F.col("node") == F.col("_gone"), "left_anti"), docs)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM docs
), grams AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS gram FROM sets
), common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * shared >= 75 * (len(x.s) + len(y.s) - shared)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), component AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN component USING (doc_id)
"""
