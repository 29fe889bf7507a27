"""Near-duplicates, passages, pieces and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import exact_dedup, hashing, minhash, substring
from lodestone.llm.sentencepiece_codec import SPACE, Codec, Pieces, decoded, encoded, round_trip

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def against_sql(frame, sql, sf=SF):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(sql).df()
    got = frame.toPandas()[list(want.columns)]
    return got.sort_values("doc_id").values.tolist(), want.sort_values("doc_id").values.tolist()


@pytest.mark.parametrize(("query", "sql"), [(exact_dedup.op4_exact_dedup, exact_dedup.ORACLE_SQL), (minhash.op5_near_dedup, minhash.ORACLE_SQL), (substring.op7_passages, substring.ORACLE_SQL)])
def test_against_sql(spark, query, sql):
    got, want = against_sql(query(spark, SF), sql)
    assert got == want


def shingle_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_by_brute_force(spark):
    """Groups of near copies, chains of them, and a passage that many otherwise different documents share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    texts = []
    for size in (12, 60):
        base = [word() for _ in range(80)]
        for _ in range(size):
            base = base.copy()
            base[rng.randrange(80)] = word()
            texts.append(" ".join(base))
    texts += [" ".join([*(word() for _ in range(rng.randrange(2, 40))), *passage]) for _ in range(80)]
    texts += ["one two", "ONE two", "", None, "x", "a b c d e", "a b c d e f"]
    sets = [shingle_sets(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark, docs).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(len(texts))] == [(len(s), root(i), root(i) == i) for i, s in enumerate(sets)]
    left = minhash.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns and left.count() == sum(root(i) == i for i in range(len(texts)))


def templates(n, words=200, own=17, seed=8):
    """Documents that share all but a few words, spread so that any two are at about 0.66."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=7))
    base = [word() for _ in range(words)]
    for _ in range(n):
        text = base.copy()
        for k in range(own):
            text[k * (words // own) + 3] = word()
        yield " ".join(text)


def test_templates_are_hardly_compared(spark):
    """Pairs to compare don't grow with the square of the documents that share a template."""
    a, b = (shingle_sets(t) for t in templates(2))
    assert 0.3 < len(a & b) / len(a | b) < 0.75
    texts = list(templates(1500, own=8))
    a, b = map(shingle_sets, texts[:2])
    assert 0.6 < len(a & b) / len(a | b) < 0.72
    texts += [texts[0] + " x", texts[7] + " y z"]
    space = minhash.Workspace(spark, "templates")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark, docs, space=space).collect()}
    assert got == {i: {1500: 0, 1501: 7}.get(i, i) for i in range(1502)}
    assert spark.read.parquet(f"{space.path}/pairs").count() < 3000


def test_near_edges(spark):
    rows = [(1, "a b c d e f g h"), (None, "a b c d e f g h"), (2, "a b"), (3, "A B"), (3, "a b c d e f g h"), (4, ""), (5, None), (6, "w " * 100_000), (7, "w " * 90_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, bands int")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, True), (None, None, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False)], key=repr)
    assert minhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    a = hashing.mix(np.arange(2000, dtype=np.uint64), 99)
    x, y = minhash.signature(a[:1500]), minhash.signature(a[500:])
    assert abs((x == y).mean() - 0.5) < 0.08


def passages(texts):
    """By definition, over (id, text) in order."""
    first, out = {}, {}
    for i, t in texts:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in first:
                gone[k : k + 20] = [True] * 20
            else:
                first[window] = i, k
        out[i] = len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()
    return out


def test_passages_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abc") + rng.choice("xyz")
    shared = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    texts = []
    for i in range(120):
        parts = [[word() for _ in range(rng.randrange(0, 30))], rng.choice(shared), [word() for _ in range(rng.randrange(0, 30))], rng.choice(shared)]
        texts.append((i, " ".join(sum(parts, []))))
    texts += [(200, "a " * 100), (201, "a " * 100), (202, None), (203, ""), (204, texts[0][1]), (205, "a b " * 50)]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id int, text string, s int")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.without_repeats(spark, docs).collect()}
    assert got == passages(texts)


def test_levels(spark):
    """Any first length leads to the same result, and the two hashes of words have nothing to do with each other."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(14)]
    texts = [(i, " ".join([*common, *(rng.choice("xy") for _ in range(16))])) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    for start in (3, 10):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.without_repeats(spark, docs, start=start).collect()}
        assert got == passages(texts)
    assert substring.lengths(5, 20) == [5, 10] and substring.lengths(3, 20) == [3, 6, 12] and substring.lengths(19, 20) == [19]
    a, b = (hashing.words(" ".join(f"w{i}" for i in range(5000)).encode(), k) for k in (0, 1))
    assert abs(np.corrcoef(a.astype(float), b.astype(float))[0, 1]) < 0.05 and len(np.unique(a ^ b)) == 5000


def test_passage_edges(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long), (None, long), (3, "short text"), (3, "short text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.without_repeats(spark, docs).collect()), key=repr)
    assert got == sorted([(1, 60_000, 0), (2, 60_000, 60_000), (None, 60_000, 60_000), (3, 2, 0), (3, 2, 0), (4, 0, 0)], key=repr)
    assert substring.without_repeats(spark, docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120))
def test_words_are_what_the_pattern_says(raw):
    assert len(hashing.words(raw)) == len(raw.split())
    assert hashing.words(raw).tolist() == [hashing.words(w)[0] for w in raw.split()]


@pytest.fixture(scope="module")
def pair():
    from sentencepiece import SentencePieceProcessor

    return Codec(PIECES), SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=500, deadline=None)
@given(text=st.text(st.sampled_from(list("  abetinrs.\n1é日😀▁<>$%=-")) | st.characters(codec="utf-8"), max_size=60))
def test_pieces_are_the_librarys(pair, text):
    codec, library = pair
    ids = codec.encode([text])[0]
    assert ids.tolist() == library.encode(text)
    assert codec.decode(ids) == text.replace(SPACE, " ")


def test_pieces_of_documents(spark, pair):
    codec, library = pair
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [" " * n + "x" for n in range(40)] + ["=" * 3000, "日" * 3000, ""]
    assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts)


def test_words_of_all_lengths_advance_together(monkeypatch):
    """A step of the search is made for all words at once, not for each length and each width of a piece."""
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 30))) for _ in range(3000)]
    codec, seen, plain = Codec(PIECES), [], Pieces.apart
    monkeypatch.setattr(Pieces, "apart", lambda self, a, b: seen.append(len(a)) or plain(self, a, b))
    codec.encode([" ".join(words)])
    assert len(seen) <= 31


def test_pieces_keep_few_words_at_once():
    """Texts are cut into words a few at a time, so a portion of 4 MB needs little beside its ids."""
    import tracemalloc

    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=3)) for _ in range(1000)]
    texts = [" ".join(rng.choices(words, k=4000)) for _ in range(250)]
    codec = Codec(PIECES)
    codec.encode(texts[:1])
    tracemalloc.start()
    try:
        ids = codec.encode(texts)
        assert tracemalloc.get_traced_memory()[1] - sum(x.nbytes for x in ids) < 30e6
    finally:
        tracemalloc.stop()


def unigram(path, pieces):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    for text, score, kind in pieces:
        model.pieces.add(piece=text, score=score, type=kind)
    model.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_unigram_models_take_the_best_sum(tmp_path):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(1)
    words = {"".join(rng.choices("ab▁", k=rng.randrange(1, 5))) for _ in range(60)} | set("ab▁")
    path = unigram(tmp_path / "u.model", [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((w, -rng.random() * 9 - 1, 1) for w in sorted(words))])
    codec, library = Codec(path), SentencePieceProcessor(model_file=path)
    score = {i: library.get_score(i) for i in range(library.get_piece_size())}
    for _ in range(200):
        text = "".join(rng.choices("ab ", k=rng.randrange(0, 20)))
        mine, theirs = codec.encode([text])[0].tolist(), library.encode(text)
        assert sum(score[i] for i in mine) == pytest.approx(sum(score[i] for i in theirs), abs=1e-4)
        assert codec.decode(np.array(mine, int)) == text


def test_piece_columns(spark):
    docs = spark.createDataFrame([(1, "some text", 1), (None, None, 2), (2, "", 3), (2, "x" * 200_000, 4)], "doc_id bigint, text string, ids int")
    ids = encoded(docs, PIECES)
    back = decoded(ids, PIECES)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in [(1, "some text", 1), (None, None, 2), (2, "", 3), (2, "x" * 200_000, 4)])
    assert all(r["exact"] for r in round_trip(docs, PIECES).collect())
    assert round_trip(docs.limit(0), PIECES).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    from lodestone.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        if name == "language":
            assert out.count() == docs.count()
        at = out
    ids = {r["doc_id"] for r in at.select("doc_id").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    newest = {}
    for i, t in rows.items():
        newest[t] = max(i, newest.get(t, -1))
    assert ids <= set(newest.values())
    taken = mixing.Mix(spark, at).per_document()
    total = corpus_pipeline.mix(spark, at, SF)
    assert sum(len(r["text"].encode().split()) for r in total.collect()) == sum(r["taken"] for r in taken.collect())
    last = corpus_pipeline.run(spark, SF)
    assert last.where("NOT exact").isEmpty() and last.count() == total.count()


def test_labels_are_merged_by_what_is_new(spark, monkeypatch):
    """The same components as from all edges at once, and edges that are labelled already aren't passed along again."""
    from lodestone.llm import minhash
    from lodestone.llm.common import Workspace

    space = Workspace(spark, "merged")
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    old = [(10, i) for i in range(11, 40)] + [(50, 51), (50, 52), (70, 71), (80, 81)]
    new = [(12, 13), (39, 51), (3, 52), (90, 91), (91, 95), (80, 81), (71, 100)]
    want = {tuple(r) for r in minhash.components(table(old + new), space, "whole").collect()}
    labels, seen, plain = minhash.components(table(old), space, "old"), [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges, *a: seen.append(edges.count()) or plain(edges, *a))
    got = [tuple(r) for r in minhash.merged(labels, table(new), space, "more").collect()]
    assert len(got) == len(want) and set(got) == want
    assert seen == [5]
