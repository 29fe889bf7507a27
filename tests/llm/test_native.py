"""Exact deduplication, mixing and personal data."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, pii

SCHEMA = "doc_id bigint, text string, source string, keep_id string"
ROWS = [
    (1, "a", "x", "p"), (2, "b", "y", None), (3, "a", "x", "q"), (None, None, None, "r"), (5, "", "y", None), (5, "", "y", "s"), (7, "c d", "x", "t"), (7, "c d", "x", "t"),
    (8, "word " * 3000, "x", None), (9, "é 😀 b", None, "u"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_exact_decisions(spark, docs):
    rows = exact_dedup.decisions(spark, docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        texts = [t or "" for i, t, _, _ in ROWS if i == r["doc_id"]]
        assert r["text_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    kept = sorted(r["doc_id"] for r in rows if r["kept"])
    assert kept == [2, 3, 5, 7, 8, 9]
    assert {r["keep_id"] for r in rows if r["doc_id"] in (None, 5)} == {5}
    assert {r["group_size"] for r in rows if r["doc_id"] in (None, 5)} == {3}


def test_exact_tells_different_texts_under_one_digest_apart(spark, docs):
    weak = exact_dedup.decisions(spark, docs, digest=lambda c: F.unhex(F.hex(F.length(c))))
    plain = exact_dedup.decisions(spark, docs)
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(repr, weak.select(columns).collect())) == sorted(map(repr, plain.select(columns).collect()))


def test_exact_drop_keeps_columns(spark, docs):
    out = exact_dedup.drop_duplicates(spark, docs)
    assert out.columns == docs.columns and out.count() == 6
    assert exact_dedup.drop_duplicates(spark, docs.limit(0)).count() == 0


def test_state_goes_on(spark, docs, tmp_path):
    """A second call with more rows finds the first call's entries."""
    slim = "d binary, id bigint, f string, r bigint"
    path, state = str(tmp_path / "slim"), str(tmp_path / "state")
    for rows in ([(b"x", 1, "f", 0), (b"y", 2, "f", 1)], [(b"x", 9, "g", 0)]):
        df = spark.createDataFrame([(bytearray(a), *b) for a, *b in rows], slim)
        df.write.mode("append").parquet(path)
        got = {bytes(r["d"]): (r["n"], r["keep"]["id"]) for r in exact_dedup.absorb(spark, df, path, state, 1 << 30).collect()}
    assert got == {b"x": (2, 9), b"y": (1, 2)}


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 7, 10, 97, 4096, 5003):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("key"))).collect()]
        assert sorted(got) == list(range(n))
        if n > 90:
            assert got != sorted(got)


def water(sizes, ratio, cap):
    """Targets by resharing again and again."""
    weights = {s: ratio[i % len(ratio)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = sum(w for s, w in weights.items() if s not in full)
        out = {s: cap * sizes[s] if s in full else left * weights[s] / open_ for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets(spark):
    sizes = {"b": 100, "a": 3, None: 40, "c": 0, "d": 7}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.targets(rows, (5, 2, 1), 3).collect()}
    assert got == pytest.approx(water(sizes, (5, 2, 1), 3))


def test_mix(spark):
    texts = [(i, " ".join(["w"] * (i * 7 % 50)), ["a", "b", None][i % 3]) for i in range(120)] + [(None, None, "z"), (None, "one two", "z")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, source string")
    rows, again = (mixing.Mix(spark, docs, block=8, slots_a_shard=16).per_document().collect() for _ in range(2))
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == 122
    for source in ("a", "b", None, "z"):
        part = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 8
        assert sum(r["size"] for r in part) == part[0]["source_size"]
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.Mix(spark, docs.limit(0)).per_document().count() == 0


def test_mix_takes_what_the_slots_say(spark):
    """Blocks, passes and cuts by hand, from the slots that were dealt."""
    texts = [(i % 50 or None, " ".join(["w"] * (i * 7 % 50)), ["a", "b", None][i % 3]) for i in range(200)]
    mix = mixing.Mix(spark, spark.createDataFrame(texts, "doc_id bigint, text string, source string"), block=8, slots_a_shard=16)
    sources = {r["sid"]: r for r in mix.sources.collect()}
    slots, docs, taken = mix.slots.collect(), mix.docs.collect(), mix.per_document().collect()
    assert sorted((r["shard"], r["position"]) for r in slots) == [(k // 16, k % 16) for k in range(len(slots))]
    for sid, s in sources.items():
        own = sorted((r["pass"], r["idx"], r["words"]) for r in slots if r["sid"] == sid)
        assert len(own) == s["slots"] and [x[:2] for x in own if x[0] < s["passes"]] == [(p, i) for p in range(s["passes"]) for i in range(s["n"])]
        places = sorted((d["at"], d["size"]) for d in docs if d["sid"] == sid and d["size"])
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        words = {}
        for _, idx, most in own:
            for w in range(idx * 8, min(idx * 8 + most, s["source_size"])):
                words[w] = words.get(w, 0) + 1
        want = sorted((d["id"] or 0, d["size"], sum(words.get(w, 0) for w in range(d["at"], d["at"] + d["size"]))) for d in docs if d["sid"] == sid)
        assert sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in taken if r["source"] == s["source"]) == want


def test_shards_draw_their_counts(spark):
    docs = spark.createDataFrame([(i, "w " * 512, "abcd"[i % 4]) for i in range(400)], "doc_id bigint, text string, source string")
    mix = mixing.Mix(spark, docs, block=1, slots_a_shard=64)
    share = {r["sid"]: r["slots"] / mix.all for r in mix.sources.collect()}
    drawn, counts = mix.drawn.toPandas(), mix.counts.toPandas()
    assert counts.groupby("sid")["c"].sum().to_dict() == {r["sid"]: r["slots"] for r in mix.sources.collect()}
    assert (counts.groupby("shard")["c"].sum() == counts.groupby("shard")["size"].first()).all()
    whole = drawn[drawn["size"] == 64]
    for sid, p in share.items():
        d = whole[whole["sid"] == sid]["d"]
        assert abs(d.mean() - 64 * p) < 0.5 and 0.85 < d.var() / (64 * p * (1 - p)) < 1.15
    changed = counts.merge(drawn, on=["shard", "sid"], how="left").fillna(0)
    assert (changed["c"] - changed["d"]).abs().sum() < 0.03 * mix.all  # what is put right is little


def words_of(rows):
    found = {}
    for r in rows:
        found[r["doc_id"], r["tag"]] = found.get((r["doc_id"], r["tag"]), 0) + len(r["text"].split())
    return found


def test_repeated_takes_what_the_mix_says(spark):
    docs = spark.createDataFrame([(i, f"d{i} " + "w x " * 20, "ab"[i % 2], 1) for i in range(40)], "doc_id bigint, text string, source string, _id int")
    taken = {r["doc_id"]: r["taken"] for r in mixing.Mix(spark, docs, block=8).per_document().collect()}
    out = mixing.repeated(spark, docs, block=8)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}


def test_repeated_rows_and_ids(spark):
    """Each row has draws of its own, though it shares its id, or has none, or is there again."""
    rows = [(None, f"none{i} " * 30, "a", i) for i in range(30)] + [(7, f"seven{i} " * 30, "b", i) for i in range(30)] + [(8, "same " * 30, "b", 0)] * 2500 + [(9, None, "c", 0), (None, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tag int")
    assert docs.columns == mixing.repeated(spark, docs.limit(0)).columns and mixing.repeated(spark, docs.limit(0)).count() == 0
    mix = mixing.Mix(spark, docs, block=8)
    out = mixing.repeated(spark, docs, block=8).collect()
    assert sum(len(r["text"].split()) for r in out) == sum(r["taken"] for r in mix.per_document().collect())
    for r in out:
        assert set(r["text"].split()) == {f"none{r['tag']}" if r["doc_id"] is None else f"seven{r['tag']}" if r["doc_id"] == 7 else "same"}
    assert mix.per_document().count() == len(rows)


# The base patterns as they were given.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "no data here", "a@b.c+d@e.f @x.y a@b@c.d a@b .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000",
    "+1 (706) 555-3138 +12 +1-------2 + 123456789 +1(((((", "é😀 me@x.org 😀 +49 30 1234567, 8.8.8.8", "a" * 50_000, "1" * 50_000, "x@" * 5_000, "+1 " * 3_000, "call +1 706 555 3138 " * 400,
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id int, text string, email string")
    for r in pii.detected(spark, docs).collect():
        got = [f"{k}:{x['s']}:{x['e']}" for k in pii.KINDS for x in r[k]]
        assert got == base(TEXTS[r["id"]]), TEXTS[r["id"]][:50]


def test_op2_by_brute_force(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in pii.op2_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for d in docs:
        found, r = base(d["text"]), rows[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and r["spans"].split(",")[: len(found)] == (found or [""])[: len(found)]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(f"{k}:") for x in found) for k in pii.KINDS]


def test_long_lists_of_numbers(spark):
    """A megabyte of numbers, of addresses, or of card numbers: time grows with the length."""
    import time

    texts = ["12," * 350_000, "1.2.3.4 " * 130_000, "4111111111111111, " * 60_000]
    for text in texts:
        began = time.time()
        got = spark.createDataFrame([(text,)], "t string").select(*[F.size(x).alias(k) for k, x in pii.base_spans(F.col("t")).items()]).first()
        assert [got[k] for k in pii.KINDS] == [sum(x.startswith(f"{k}:") for x in base(text)) for k in pii.KINDS]
        assert time.time() - began < 30
    few = spark.createDataFrame([(0, "a1@b.c and words " * 3_000)], "doc_id int, text string")
    assert len(pii.detected(spark, few).first()["email"]) == 3_000


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"agent orlov writes from me@x.org about item {i}") for i in range(4)] + [(10 + i, "other people write about item and item") for i in range(30)]
    docs = spark.createDataFrame([(*r, "s") for r in rows] + [(None, None, None)], "doc_id int, text string, spans string")
    out = {r["doc_id"]: r for r in pii.sanitised(spark, docs).collect()}
    assert "orlov" not in out[0]["sanitised"] and "[EMAIL]" in out[0]["sanitised"]
    assert "about item 0" in out[0]["sanitised"]  # said everywhere, so it gives nothing away
    assert out[12]["sanitised"] == rows[6][1] and out[12]["spans"] == []
    assert out[None]["sanitised"] == ""
    assert pii.sanitised(spark, docs.limit(0)).count() == 0


def test_terms_of_entities_said_once(spark):
    texts = ["agent orlov writes from me@x.org about item", "clerk petrov calls 8.8.8.8 about item"] + ["other people write about item and item"] * 30
    out = {r["doc_id"]: r["sanitised"] for r in pii.sanitised(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert "orlov" not in out[0] and "petrov" not in out[1]
    assert out[0].endswith("about item") and out[1].endswith("about item") and out[2] == texts[2]


def test_disclosing_terms_go_wherever_they_are_said(spark):
    far, agent = " and so on" * 20, "agent orlov writes from me@x.org"
    texts = [f"{agent}{far} Orlov{far} orlov@y.org", agent + far, "then ORLOV left", agent + far]
    texts += [f"call 8.8.8.8 {'w ' * 22}straddling{far}", "call 9.9.9.9 " + "w " * 24 + "outside" + far, f"{far} leading {'w ' * 21}7.7.7.7"] + ["other people write and call so on " * 1000] * 30
    out = {r["doc_id"]: r for r in pii.sanitised(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert not any("orlov" in out[i]["sanitised"].lower() for i in range(4)) and out[0]["sanitised"].endswith("[EMAIL]")
    assert "straddling" not in out[4]["sanitised"] and "leading" not in out[6]["sanitised"]  # the window's edge lies within
    assert "outside" in out[5]["sanitised"] and out[7]["spans"] == []
