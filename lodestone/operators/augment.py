"""More examples by synonyms, openings and endings; all choices hash the row, so reruns and other engines agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import replace_first

# Replacements in their order, openings and endings (none among them).
SYNONYMS = (
    ("退款", "退钱"), ("退货", "退还商品"), ("快递", "包裹"), ("物流", "运输"), ("发票", "票据"),
    ("充电器", "充电头"), ("耳机", "蓝牙耳机"), ("怎么办", "怎么处理"), ("能不能", "可以不可以"), ("几天", "多久"),
)
PREFIXES = ("你好，", "在吗，", "麻烦问一下，", "急，", "想咨询一下，", "")
SUFFIXES = ("谢谢", "麻烦尽快回复", "急等", "在线等", "谢谢了", "")
CHANCE = 0.4


def draw(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts' text alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def augment(examples: DataFrame, *, seed: int = 20260101, factor: int = 3, synonyms: Sequence[tuple[str, str]] = SYNONYMS, prefixes: Sequence[str] = PREFIXES, suffixes: Sequence[str] = SUFFIXES, chance: float = CHANCE) -> DataFrame:
    """doc_id, pass (0 for the originals), text, label_id. Of equal texts the first stays, in order of pass and id."""
    rows = examples.select("doc_id", "label_id", "text", F.explode(F.sequence(F.lit(1), F.lit(factor))).alias("pass"))
    key = F.concat_ws("|", F.lit(seed), "pass", "doc_id")
    s = F.col("text")
    for i, (old, new) in enumerate(synonyms):
        lucky = draw(key, F.lit(f"s{i}")) < int(chance * 2**32)
        rows = rows.withColumn("text", F.when(F.contains("text", F.lit(old)) & lucky, replace_first("text", old, new)).otherwise(F.col("text")))
    pick = lambda name, choices: F.element_at(F.array(*map(F.lit, choices)), (draw(key, F.lit(name)) % len(choices) + 1).cast("int"))
    rows = rows.withColumn("text", F.concat(pick("p", prefixes), s, pick("q", suffixes)))
    every = examples.select("doc_id", F.lit(0).alias("pass"), "text", "label_id").unionByName(rows.select("doc_id", "pass", "text", "label_id"))
    turn = F.row_number().over(Window.partitionBy("text").orderBy("pass", "doc_id"))
    return every.withColumn("turn", turn).where((F.col("pass") == 0) | ((F.col("turn") == 1) & (F.trim("text") != ""))).drop("turn")
