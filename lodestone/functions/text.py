"""Tokens, character n-grams and contrast clauses as Column expressions. Nulls count as empty texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate chunks (white space included) ...
SEPARATORS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000" + ",，。！？!?、；;：:（）()[]【】\"'“”‘’—-_/\\|~`@#$%^&*+=<>《》…·"
# ... a character, with the next, of a chunk that has others than a-z, 0-9 and dots (chunks stand between spaces) ...
SPELLED = r"(?:\G(?<=[^ ])|(?<![^ ])(?![a-z0-9.]+(?![^ ])))([^ ])(?=([^ ]))"
# ... the function words that are no tokens ...
STOPWORDS = (
    "的 了 是 我 我们 你 你们 他 她 它 这 那 这个 那个 一下 怎么 怎样 如何 什么 为什么 哪里 可以 能否 请问 请 帮 帮我 想要 想 要 有 没有 "
    "吗 呢 啊 吧 呀 哦 嗯 和 跟 与 就 都 还 在 到 给 让 被 把 对 从 为 会 能 需要"
).split()
# ... and the words that begin a contrasting clause, in order of preference.
CONTRAST = ("但是", "但", "不过", "然而", "可是", "可", "却", "结果")


def no_strings() -> Column:
    return F.array().cast("array<string>")


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def tokenize(text: Column | str, keep_stopwords: bool = False) -> Column:
    """Chunks of a-z, 0-9 and dots are tokens; of other chunks, each character and, after it, the pair it begins.
    Stopwords go, unless kept. Then follows '#' with each run of digits in the text. Order and repeats are kept."""
    text = _text(text)
    chunks = F.translate(F.lower(text), SEPARATORS, " " * len(SEPARATORS))
    stop = () if keep_stopwords else STOPWORDS
    words = F.filter(F.split(F.regexp_replace(chunks, SPELLED, "$1 $1$2 "), " "), lambda w: ~w.isin("", *stop))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0)), lambda d: F.concat(F.lit("#"), d))
    return F.concat(words, numbers)


def char_ngrams(text: Column | str, n: int = 2) -> Column:
    """Runs of n characters of the text without separators; of a shorter text, the whole. Case is kept."""
    joined = F.translate(_text(text), SEPARATORS, "")
    grams = F.regexp_extract_all(joined, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1))
    return F.when(joined == "", no_strings()).when(F.length(joined) < n, F.array(joined)).otherwise(grams)


def contrast(query: Column | str, markers: Sequence[str] = CONTRAST) -> Column:
    """struct(head, tail) around the first marker of the list that has text before it and at least two characters
    after it; null if there is none."""
    query = _text(query)

    def around(marker: str) -> Column:
        at = F.instr(query, marker)
        fits = (at > 1) & (at - 1 + len(marker) < F.length(query) - 1)
        return F.when(fits, F.struct(F.substr(query, F.lit(1), at - 1).alias("head"), F.substr(query, at + len(marker)).alias("tail")))

    return F.coalesce(*map(around, markers))


def content(tokens: Column) -> Column:
    """The distinct tokens that aren't numbers."""
    return F.array_distinct(F.filter(tokens, lambda t: ~t.startswith("#")))


def replace_first(text: Column | str, old: str, new: str) -> Column:
    text = _text(text)
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two token arrays as multisets; 0 if either is empty."""
    counts = lambda ts, t: F.size(F.filter(ts, lambda x: x == t))
    same = F.aggregate(F.array_distinct(predicted), F.lit(0), lambda acc, t: acc + F.least(counts(predicted, t), counts(gold, t)))
    p, r = same / F.size(predicted), same / F.size(gold)
    return F.when((F.size(predicted) == 0) | (F.size(gold) == 0) | (same == 0), F.lit(0.0)).otherwise(2 * p * r / (p + r))
