"""Mixing sources to target weights, in blocks of a fixed number of words.

Each source's words, documents in a pseudorandom order, are packed into blocks of `block` words (the last may be
shorter). A source that is to give t words gets floor(t / size) passes over its blocks and one partial pass, whose
last block is cut to length: these are its slots.

Output shards hold `slots_a_shard` slots each. Every slot of a shard draws its source by the sources' shares, so a
shard's counts are a multinomial draw. What all draws together miss of the targets is then put right: a source drawn
too often gives slots back, evenly over the shards in proportion to its draws, and the slots given back go to the
sources drawn too seldom, by a pseudorandom permutation. Slots of a source are numbered through the shards; slot q of
a pass takes the block that the source's own permutation maps q to, and blocks are joined by that index.

The permutations are alternating modular Feistel rounds over a x b >= n indices, walked until they fall below n:
any index maps without a table. Prefix sums work in two levels by (source, hash bucket), so that no source is gathered
in one task; of rows that are the same in id, size and text, a group as large as it may be is placed as one, and its
rows are numbered in salted parts.

Defined results: null text has size 0 and takes nothing. A null source is a source of its own, last in order. An
empty table, or one without any word, gives targets of 0. Rows that share an id, or have none, are told apart by their
texts; rows that are the same in both are told apart by their place in the files, which doesn't show. Further columns
are not looked at. Reruns agree: all draws hash ids, texts and indices with the seed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, Workspace, address, located, small_enough, whole_rows

#: Rows to a hash bucket of the prefix sums, on average, and buckets to a stretch of their second level.
BUCKET_ROWS = 1_000
#: Slots made by one task.
TASK_SLOTS = 1 << 18
WALKS = 64
_EARLIER = (Window.unboundedPreceding, -1)


def _step(x: Column, a: Column, b: Column, key: Column) -> Column:
    """A bijection of the indices below a * b."""
    draw = lambda salt, v, n: F.pmod(F.xxhash64(F.lit(salt), key, v), n)
    left, right = F.floor(x / b).cast("long"), x % b
    for salt in ("even", "odd"):
        left = (left + draw(salt, right, a)) % a
        right = (right + draw(salt, left, b)) % b
    return left * b + right


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of index x under the pseudorandom permutation of n indices that key names."""
    a = F.greatest(F.ceil(F.sqrt(n)).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(n / a).cast("long"), F.lit(1))
    first = _step(x, a, b, key)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda at, _: F.when(at < n, at).otherwise(_step(at, a, b, key)))
    return F.when(first < n, first).otherwise(walk)


def targets(sized: DataFrame, ratio: Sequence[int], cap: int) -> DataFrame:
    """One row per source: sid, source, source_size, target. Sources take ratio in turn, in code point order with
    null last, of all words together; what a target has above cap times its source goes to the others by weight.
    The windows run over one row per source."""
    everywhere = Window.partitionBy()
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, ratio)), (F.col("sid") % len(ratio) + 1).cast("int")))
    by = by.withColumn("most", F.col("source_size") * cap).withColumn("fills_at", F.col("most") / F.col("weight"))
    before = Window.orderBy("fills_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(everywhere), F.sum("weight").over(everywhere)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / (weights - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    by = by.withColumn("full", F.col("fills_at") < level)
    taken, left = (F.sum(F.when(F.col("full") == full, F.col(c))).over(everywhere) for full, c in ((True, "most"), (False, "weight")))
    level = (total - F.coalesce(taken, F.lit(0))) / left
    return by.select("sid", "source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.coalesce(level * F.col("weight"), F.lit(0.0))).alias("target"))


def running(rows: DataFrame, by: Sequence[str], at: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value over the rows of the same `by` with a lesser `at`, an index that occurs once
    in each. Sums of BUCKET_ROWS indices each are added up first, then those within each."""
    rows = rows.withColumn("_g", F.floor(F.col(at) / BUCKET_ROWS))
    sums = rows.groupBy(*by, "_g").agg(F.sum(value).alias("_v"))
    total = F.sum("_v").over(Window.partitionBy(*by).orderBy("_g").rowsBetween(*_EARLIER))
    sums = sums.select(*by, "_g", F.coalesce(total, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "_g").orderBy(at).rowsBetween(*_EARLIER))
    return rows.join(sums, [*by, "_g"]).withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_g", "_before")


def _owned(draws: DataFrame, shares: DataFrame, owners: int, total: int) -> DataFrame:
    """draws (with u, below total) joined with the row of shares (sid, start, width) whose stretch u lies in. Both
    meet in cells, four to an owner, so that a draw meets about one owner however many there are."""
    cells = max(1, min(4 * owners, total))
    cell = lambda x: F.floor(x * (cells / total)).cast("long")
    near = shares.where("width > 0").withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("start") + F.col("width") - 1))))
    return draws.withColumn("cell", cell(F.col("u"))).join(small_enough(near), "cell").where((F.col("u") >= F.col("start")) & (F.col("u") < F.col("start") + F.col("width"))).drop("cell")


class Mix:
    """Tables of one mix: sources, docs (one row per document with its place), counts (of slots by shard and source),
    slots, draws (documents by slot)."""

    def __init__(
        self,
        spark: SparkSession,
        docs: DataFrame,
        *,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        ratio: Sequence[int] = (5, 2, 1),
        cap: int = 3,
        block: int = 64,
        slots_a_shard: int = 1 << 12,
        seed: int = 9,
    ):
        self.spark, self.block, self.seed, self.shard, self.space = spark, block, seed, slots_a_shard, Workspace(spark, "mix")
        self.input = located(docs, self.space)
        text, at = F.coalesce(F.col(text_col), F.lit("")), place_of()
        sized = self.input.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("t"), *at)
        sized = self.space.table(sized, "sized")
        n = F.ceil(F.col("source_size") / block).cast("long")
        words = F.round("target").cast("long")
        rest = words - F.col("passes") * F.col("source_size")
        sources = targets(sized, ratio, cap).withColumn("n", n).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
        sources = sources.withColumn("rest", F.when(F.col("source_size") > 0, rest).otherwise(0)).withColumn("slots", F.col("passes") * F.col("n") + F.ceil(F.col("rest") / block))
        sources = sources.withColumn("base", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(*_EARLIER)), F.lit(0)))
        self.sources = self.space.table(sources, "sources")
        self.all, self.owners = self.sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
        self.docs = self.space.table(self._placed(sized, max(1, sized.count() // BUCKET_ROWS)), "placed")
        self.counts = self._counts()
        self.slots = self._slots()
        self.draws = self._draws()

    def _placed(self, sized: DataFrame, buckets: int) -> DataFrame:
        """Documents with the number of words before them in their source."""
        sources = small_enough(self.sources.select(F.col("source").alias("its"), "sid", "source_size", "target"))
        rows = sized.join(sources, F.col("source").eqNullSafe(F.col("its"))).drop("its").withColumn("h", F.xxhash64(F.lit(self.seed), "id", "size", "t"))
        same = ["sid", "h", "id", "size", "t"]
        groups = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("m")).withColumn("words", F.col("m") * F.col("size")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
        groups = self.space.table(groups, "groups")
        starts = running(groups.groupBy("sid", "bucket").agg(F.sum("words").alias("words")), ["sid"], "bucket", "words", "start").drop("words")
        inside = F.coalesce(F.sum("words").over(Window.partitionBy("sid", "bucket").orderBy("h", "id", "size", "t").rowsBetween(*_EARLIER)), F.lit(0))
        first = groups.withColumn("inside", inside).join(starts, ["sid", "bucket"]).select(*[F.col(c).alias(f"_{c}") for c in same], "m", (F.col("start") + F.col("inside")).alias("first"))
        placed = rows.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) if c == "id" else F.col(c) == F.col(f"_{c}") for c in same]).drop("h", "t", *[f"_{c}" for c in same])
        placed = self.space.table(placed, "joined")
        many = (F.col("m") > 1) & (F.col("size") > 0)
        alone = placed.where(~many).select("*", F.col("first").alias("at"))
        salted = placed.where(many).withColumn("salt", F.pmod(F.xxhash64("f", "r"), F.ceil(F.col("m") / BUCKET_ROWS)))
        parts = running(salted.groupBy("sid", "first", "salt").agg(F.count(F.lit(1)).alias("k")), ["sid", "first"], "salt", "k", "before").drop("k")
        turn = F.row_number().over(Window.partitionBy("sid", "first", "salt").orderBy("f", "r")) - 1
        salted = salted.withColumn("turn", turn).join(parts, ["sid", "first", "salt"])
        together = salted.withColumn("at", F.col("first") + (F.col("before") + F.col("turn")) * F.col("size"))
        return alone.unionByName(together.select(alone.columns)).drop("first", "m")

    def _counts(self) -> DataFrame:
        """shard, size (its slots), sid, c: how many slots of a shard each source has."""
        shares = self.sources.select("sid", F.col("base").alias("start"), F.col("slots").alias("width"))
        shards = -(-self.all // self.shard)
        size = F.least(F.lit(self.shard), self.all - F.col("shard") * self.shard)
        every = self.spark.range(0, shards, 1, max(1, -(-self.all // TASK_SLOTS))).select(F.col("id").alias("shard")).withColumn("size", size)
        throws = every.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
        throws = throws.select("shard", "size", F.pmod(F.xxhash64(F.lit(f"{self.seed} draw"), "shard", "i"), F.lit(max(self.all, 1))).alias("u"))
        drawn = _owned(throws, shares, self.owners, max(self.all, 1)).groupBy("shard", "size", "sid").agg(F.count(F.lit(1)).alias("d"))
        self.drawn = drawn = self.space.table(drawn, "drawn")
        total = drawn.groupBy("sid").agg(F.sum("d").alias("drawn"))
        total = self.space.table(shares.select("sid", F.col("width").alias("slots")).join(total, "sid", "left").na.fill(0, ["drawn"]), "total")
        over = small_enough(total.where("drawn > slots"))
        sums = running(drawn, ["sid"], "shard", "d", "before").join(over, "sid", "left")
        upto = lambda x: F.when(x >= F.col("drawn"), F.col("slots")).otherwise(F.floor(x * (F.col("slots") / F.col("drawn"))))
        kept = F.when(F.col("drawn").isNull(), F.col("d")).otherwise(upto(F.col("before") + F.col("d")) - upto(F.col("before")))
        kept = self.space.table(sums.select("shard", "size", "sid", kept.alias("c")), "kept")
        free = kept.groupBy("shard", "size").agg(F.sum("c").alias("c")).select("shard", "size", (F.col("size") - F.col("c")).alias("free")).where("free > 0")
        short = total.where("drawn < slots").select("sid", (F.col("slots") - F.col("drawn")).alias("width"))
        short = short.withColumn("start", F.coalesce(F.sum("width").over(Window.orderBy("sid").rowsBetween(*_EARLIER)), F.lit(0)))
        lacking = short.agg(F.coalesce(F.sum("width"), F.lit(0))).first()[0]
        if not lacking:
            return kept.where("c > 0")
        given = running(free, [], "shard", "free", "before").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("free") - 1)))
        given = given.select("shard", "size", permuted(F.col("before") + F.col("i"), F.lit(lacking), F.lit(f"{self.seed} given")).alias("u"))
        given = _owned(given, short, self.owners, lacking).groupBy("shard", "size", "sid").agg(F.count(F.lit(1)).alias("c"))
        every = kept.unionByName(given).groupBy("shard", "size", "sid").agg(F.sum("c").alias("c")).where("c > 0")
        return self.space.table(every, "counts")

    def _slots(self) -> DataFrame:
        """shard, position, sid, pass, idx (of the block), words (that the slot takes at most)."""
        within = F.sum("c").over(Window.partitionBy("shard").orderBy("sid").rowsBetween(*_EARLIER))  # a row per source
        rows = running(self.counts, ["sid"], "shard", "c", "first").withColumn("within", F.coalesce(within, F.lit(0)))
        rows = rows.repartition(max(1, -(-self.all // TASK_SLOTS)), "shard", "sid").join(small_enough(self.sources.select("sid", "n", "rest", "slots")), "sid")
        rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1))).withColumn("q", F.col("first") + F.col("i"))
        place = permuted(F.col("within") + F.col("i"), F.col("size"), F.concat(F.lit(f"{self.seed} shard "), F.col("shard").cast("string")))
        index = permuted(F.col("q") % F.col("n"), F.col("n"), F.concat(F.lit(f"{self.seed} "), F.col("sid").cast("string")))
        cut = F.col("rest") - (F.ceil(F.col("rest") / self.block) - 1) * self.block
        last = (F.col("q") == F.col("slots") - 1) & (F.col("rest") > 0)
        return rows.select("shard", place.alias("position"), "sid", F.floor(F.col("q") / F.col("n")).alias("pass"), index.alias("idx"), F.when(last, cut).otherwise(self.block).alias("words"))

    def _draws(self) -> DataFrame:
        """Slots joined with their blocks: for each document in the block, which of its words are taken. A document is
        known by its source and place, and by the file (f) and row (r) it came from."""
        docs = self.docs.where("size > 0")
        first, last = (F.floor(x / self.block) for x in (F.col("at"), F.col("at") + F.col("size") - 1))
        parts = docs.select("sid", "at", "size", "f", "r", F.explode(F.sequence(first, last)).alias("idx"))
        start = F.col("idx") * self.block
        begin = F.greatest(F.col("at"), start)
        end = F.least(F.col("at") + F.col("size"), start + F.least(F.col("words"), F.lit(self.block)))
        # Both sides grow with the input; the planner takes what unfolds from the small table of sources for small.
        return self.slots.hint("merge").join(parts, ["sid", "idx"]).where(end > begin).select("shard", "position", "pass", "sid", "at", "size", "f", "r", (begin - F.col("at")).alias("first"), (end - begin).alias("taken"))

    def per_document(self) -> DataFrame:
        taken = self.draws.groupBy("sid", "at").agg(F.sum("taken").alias("taken")).withColumn("some", F.lit(True)).hint("merge")
        some = F.col("size") > 0
        rows = self.docs.withColumn("some", some).join(taken, ["sid", "at", "some"], "left")
        return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def place_of() -> list[Column]:
    """f, a hash of the file, and r, the row in it."""
    at = address()
    return [F.xxhash64(at["f"]).alias("f"), at["r"].alias("r")]


def repeated(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: a row for each pass that takes words of a document, with its text whole if all
    words are taken, else with the taken words joined by a space; n_chars follows. Rows are told apart by where they
    stand, so they may share an id or have none; each gets its own draws. An empty table, and one without words, give
    no rows."""
    mix = Mix(spark, docs, **options)
    spans = mix.draws.groupBy("f", "r", "pass").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "taken"))).alias("spans"), F.max("size").alias("size"))
    rows = whole_rows(mix.input, *place_of(), F.col("text").alias("whole")).join(spans, ["f", "r"])
    # The words stand in an array of one, so that they are found once and not once for each span.
    words = F.array(F.regexp_extract_all("whole", F.lit(WORD), F.lit(0)))
    taken = lambda w: F.flatten(F.transform("spans", lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["taken"].cast("int"))))
    some = F.array_join(F.flatten(F.transform(words, taken)), " ")
    text = F.when(F.col("taken") == F.col("size"), F.col("whole")).otherwise(some)
    out = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Mix(spark, docs).per_document()
