"""Language, quality, media and token ids."""

import struct
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import langid, media, quality, token_output

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.op3_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "hello there", "en", 1), (2, "guten tag", "de", 2), (None, None, "en", 3), (5, "123 !!", "en", 4), (6, "", None, 5), (7, "x" * 300_000, "en", 6), (7, "日本語 😀", None, 6)], "doc_id bigint, text string, lang string, score int")
    model = langid.fit(spark, docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, model).collect()]
    assert len(got) == 7 and {lang for i, lang in got if i in (None, 5, 6)} == {"und"} and {lang for i, lang in got if i in (1, 7)} <= {"en", "de"}
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 7, 7]
    assert langid.fit(spark, docs.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_languages_that_were_not_learnt_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(spark, docs)
    odd = ["привет как дела друзья мои, сегодня мы поедем в город", "今日は天気がいいから散歩しましょう。日本語です", "xqzv wkjx qzzp vvkx bbnq zzkq", "12 34", None]
    rows = spark.createDataFrame([(-i - 1, t, None, None, 0) for i, t in enumerate(odd)], docs.schema)
    left = {r["doc_id"] for r in langid.accepted(docs.unionByName(rows), model).select("doc_id").collect()}
    assert left == {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").select("doc_id").collect()}
    assert langid.accepted(rows, None).count() == len(odd)


def test_every_language_can_be_predicted(spark):
    """More than 400 languages, some of them said once, and rows that are there many times."""
    rows = [(i * 8 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{i % 7}z " * 12, f"lang{i:03}") for i in range(450) for k in range(1 + 5 * (i % 3 == 0))]
    docs = spark.createDataFrame([*rows, *[(0, "same words again", "lang000")] * 500], "doc_id bigint, text string, lang string").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    model = langid.fit(spark, docs, sample=600)
    assert set(model.langs) == {r["lang"] for r in docs.select("lang").distinct().collect()} and len(model.langs) > 300
    again = langid.fit(spark, docs.orderBy(F.desc("text")), sample=600)
    assert again.langs == model.langs and np.array_equal(again.weights, model.weights)


def test_presence_sets():
    sets = langid.Presence()
    a = set(sets("ab ab!").tolist())
    assert a == set(sets("AB, ab").tolist())
    s, x, y = 0, 1, 2
    pair = lambda p, q: 64 + p * 64 + q
    three = lambda p, q, r: 64 + 4096 + (p * 64 + q) * 64 + r
    assert a == {s, x, y, pair(s, x), pair(x, y), pair(y, s), three(s, x, y), three(x, y, s), three(y, s, x)}
    assert not len(sets(None)) and not len(sets("12"))


def test_quality_on_held_out_rows(spark):
    rows = quality.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "fine words", "a"), (2, None, "b"), (None, "", "c"), (3, "w " * 200_000, "d"), (3, "w", "d")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 7), (None, 1), (99, 1)], "doc_id bigint, quality int")
    for model in (quality.fit(spark, docs, labels), quality.fit(spark, docs, labels.limit(0))):
        rows = quality.predict(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.predict(docs.limit(0), model).count() == 0


def test_word_features_do_not_depend_on_the_batch():
    words = [b"a", b"word", b"longer-word", b"\xc3\xa9"]
    together, n = quality.word_features(words)
    alone = [quality.word_features([w])[0] for w in words]
    parts = np.split(together, np.cumsum(n)[:-1])
    assert all(sorted(x) == sorted(y) for x, y in zip(parts, alone, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_media_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload.startswith(raw) and payload
    stored = media.store(payload)
    (track,), error = media.walk(stored)
    assert error is None and media.samples(stored, track) == payload
    assert (track["codec"], track["timescale"], track["duration"], track["samples"]) == ("raw ", 25, len(payload) // 64, len(payload) // 64)
    assert track["keys"].tolist() == list(range(0, len(payload) // 64, 16))
    assert stored[track["starts"][0] :][:64] == payload[:64]


def test_media_of_other_shapes():
    stored = media.store(bytes(range(64)) * 40)
    for broken in (None, b"", b"\0\0", stored[:-1], stored[:200], b"\0\0\0\x04moov" + stored):
        tracks, error = media.walk(broken)
        assert error or not tracks
    to_end = b"\0\0\0\0free" + bytes(20)  # size 0 runs to the end
    assert media.walk(stored + to_end)[1] is None
    wide = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    (track,), error = media.walk(stored + wide)
    assert error is None and track["samples"] == 40
    # stco and per-sample sizes, without stss: every sample is a keyframe
    full = lambda k, *p: media._full(k, *p)
    table = media._box(b"stbl", full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(70))), full(b"stts", struct.pack(">III", 1, 3, 10)), full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), full(b"stsz", struct.pack(">IIIII", 0, 3, 2, 3, 4)), full(b"stco", struct.pack(">III", 2, 8, 20)))
    moov = media._box(b"moov", media._box(b"trak", media._box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 30, 0, 0)), media._box(b"minf", table))))
    (track,), error = media.walk(media._box(b"free", bytes(30)) + moov)
    assert error is None and track["starts"].tolist() == [8, 10, 20] and track["keys"].tolist() == [0, 1, 2] and track["codec"] == "avc1"


def test_media_of_a_good_and_a_broken_track():
    stored = media.store(bytes(range(64)) * 40)
    (a, b), = [(a, b) for kind, a, b in media.boxes(memoryview(stored), 0, len(stored)) if kind == b"moov"]
    good = next(stored[c - 8 : d] for kind, c, d in media.boxes(memoryview(stored), a, b) if kind == b"trak")
    bad = good.replace(b"stsz", b"stzz")
    for order in ((good, bad), (bad, good)):
        tracks, error = media.walk(media._box(b"free", bytes(len(stored))) + media._box(b"moov", *order))
        assert [t["samples"] for t in tracks] == [40] and "stsz" in error


def test_damaged_media_is_told():
    """Whatever is damaged, walk() returns, and takes no more memory than the file allows."""
    rng = np.random.default_rng(3)
    stored = media.store(bytes(range(64)) * 40)
    for _ in range(3000):
        raw = bytearray(stored)
        for at in rng.integers(0, 900, rng.integers(1, 6)):
            raw[at] = rng.choice((0, 1, 255, int(rng.integers(256))))
        tracks, error = media.walk(bytes(raw))
        for t in tracks:
            assert error or media.samples(bytes(raw), t) is not None
            assert len(t["keys"]) <= t["samples"] <= len(raw)
    deep = b""
    for _ in range(3000):
        deep = media._box(b"mdia", deep)
    assert "deep" in media.walk(media._box(b"moov", media._box(b"trak", deep)))[1]
    claim = stored.replace(struct.pack(">II", 64, 40), struct.pack(">II", 64, 2**32 - 1))
    assert claim != stored and media.walk(claim)[1]


def test_compact_sizes_and_fragments():
    full, box = media._full, media._box
    head = lambda *tables: box(b"moov", box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0)), box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"hvc1", bytes(70))), *tables)))), box(b"mvex", full(b"trex", struct.pack(">IIIII", 7, 1, 10, 5, 0x10000))))
    for bits, packed in ((4, bytes([0x23, 0x40])), (8, bytes([2, 3, 4])), (16, struct.pack(">HHH", 2, 3, 4))):
        moov = head(full(b"stts", struct.pack(">III", 1, 3, 10)), full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)), full(b"stz2", struct.pack(">II", bits, 3), packed), full(b"stco", struct.pack(">II", 1, 8)))
        (track,), error = media.walk(box(b"free", bytes(30)) + moov)
        assert error is None and track["sizes"].tolist() == [2, 3, 4] and track["starts"].tolist() == [8, 10, 13]
    none = struct.pack(">I", 0)
    moov = head(full(b"stts", none), full(b"stsc", none), full(b"stsz", none, none), full(b"stco", none))

    def moof(offset):
        run = full(b"trun", struct.pack(">Ii", 3, offset), struct.pack(">I", 0), struct.pack(">III", 4, 5, 6), flags=0x1 | 0x4 | 0x200)
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), run, full(b"trun", struct.pack(">I", 2))))

    part = moof(len(moof(0)) + 8) + box(b"mdat", bytes(25))
    (track,), error = media.walk(moov + part + part)
    at = len(moov) + len(moof(0)) + 8
    assert error is None and track["starts"].tolist() == [x + k * len(part) for k in (0, 1) for x in (at, at + 4, at + 9, at + 15, at + 20)]
    assert track["sizes"].tolist() == [4, 5, 6, 5, 5] * 2 and track["keys"].tolist() == [0, 5] and track["duration"] == 100 and track["codec"] == "hvc1"


def test_op8_gives_each_text_back(spark):
    import hashlib

    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = media.op8_media(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        payload = media.padded(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(docs[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.store(payload)), hashlib.sha256(media.store(payload)).hexdigest())


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, ""), (None, "é" * 100_000)], "doc_id int, text string")
    kept = media.contained(docs)
    rows = media.described(kept, id_col="doc_id", content_col="media").collect()
    assert len(rows) == 4 and all(r["error"] is None and r["tracks"][0]["codec"] == "raw " for r in rows)
    assert rows[3]["tracks"][0]["keyframes"][1]["size"] == 64
    assert media.described(spark.createDataFrame([(1, None)], "doc_id int, media binary"), id_col="doc_id", content_col="media").first()["tracks"] == []
    assert media.contained(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_any_token_is_addressable(ids, data):
    segment = token_output.Segment(token_output.encode(np.array(ids, np.uint64)))
    assert segment.get(np.arange(len(ids))).tolist() == ids == segment.all().tolist()
    if ids:
        places = data.draw(st.lists(st.integers(0, len(ids) - 1), max_size=20))
        assert segment.get(np.array(places, int)).tolist() == [ids[p] for p in places]
    with pytest.raises(IndexError):
        segment.get(np.array([len(ids)]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t aB1é.'s_ 　\x85日😀")) | st.characters(codec="utf-8"), max_size=40), max_size=4))
def test_ids_are_the_tokenizers(texts):
    encoder = token_output.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*texts, "x <|endoftext|> y", "a  <|endoftext|>"]
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder(texts)] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aZéßȀɏªµ×÷7.'%_~\n")), min_size=1, max_size=12).filter(lambda w: not (w[0] + w[-1]).count("\n")), max_size=6))
def test_units_are_the_tokenizers(words):
    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(["x", *words])
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder([text])[0].tolist() == want == encoder([text])[0].tolist()


def test_units_of_latin_letters_and_marks_need_no_pattern(monkeypatch):
    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole, seen = encoder.tokenizer, []

    class Seen:
        def encode_batch_fast(self, texts, **how):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, **how)

    texts = ["x schön und größer.\nWas élève, heat*** 2.0. a@b7 x"]
    monkeypatch.setattr(encoder, "tokenizer", Seen())
    got = encoder(texts)
    assert seen == ["x"] and got[0].tolist() == whole.encode(texts[0], add_special_tokens=False).ids


def test_what_is_forgotten_is_learnt_anew(monkeypatch):
    monkeypatch.setattr(token_output, "MEMORY", 3)
    monkeypatch.setattr(token_output, "INNER", 2, raising=False)
    encoder = token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = "x " + " ".join(f"{w}.{m}?{w}" for w in "a b c d e a b c".split() for m in "uvw")
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder([text, text])[1].tolist() == want and len(encoder.known) <= 3 >= len(encoder.known.older)


def test_op10_against_the_library(spark):
    rows = {r["doc_id"]: r for r in token_output.op10_token_ids(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    tokenizer, at = token_output.encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer, 0
    assert len(rows) == len(docs)
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        r = rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT", 50)
    texts = [(5, "five words are in here"), (1, None), (None, "first"), (3, "x " * 3000), (3, "x"), (9, "")]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id bigint, text string, start int")
    table = token_output.write(spark, docs, str(tmp_path / "ids"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), partitions=3)
    got = token_output.per_document(table).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 3, 3, 5, 9]
    encoder, at = token_output.encoder(public_tokenizers.path("byte_bpe_50k.json")), 0
    order = sorted(((t or "", i) for i, t in texts), key=lambda x: (x[1] is not None, x[1] or 0, np.uint64(xxhash.xxh64(x[0].encode(), seed=42).intdigest()).astype(np.int64)))
    every = []
    for r, (text, _) in zip(got, order, strict=True):
        ids = np.append(np.frombuffer(encoder.plain([text])[0], np.uint32), np.uint32(0))
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        at += len(ids)
        every += ids.tolist()
    places = spark.createDataFrame([(i,) for i in (0, 7, 7, at - 1, at, -1, None, *range(100, 400, 7))], "place bigint")
    found = {r["place"]: r["id"] for r in token_output.tokens_at(table, places).collect()}
    assert found == {i: every[i] for i in (0, 7, at - 1, *range(100, 400, 7))}
    empty = token_output.write(spark, docs.limit(0), str(tmp_path / "none"), tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    assert token_output.per_document(empty).select(F.count("*")).first()[0] == 0
