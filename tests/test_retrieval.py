import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.operators.retrieval import Retrieval, nearest
from lodestone.plans.retrieval import Evaluation, search, search_json, strategies
from lodestone.sources import tables

ROWS = [
    {"id": "D1", "title": "red lamp", "text": "the red lamp won't switch on", "cat": "lamp", "group": "G1", "helpful": True},
    {"id": "D2", "title": "red lamp again", "text": "the red lamp flickers", "cat": "lamp", "group": "G1", "helpful": True},
    {"id": "D3", "title": "blue kettle", "text": "kettle boils but lamp stays dark", "cat": "kettle", "group": "G2", "helpful": False},
    {"id": "D4", "title": "", "text": "", "cat": "none", "group": "G3"},
    {"id": "D5", "title": "parcel", "text": "parcel lost", "cat": "post", "group": "G4"},
]


@pytest.fixture(scope="module")
def engine(spark):
    return Retrieval(tables.Corpus.of_tickets(tables.tickets(spark, ROWS)), pool_size=4)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, q string")


def bag(text):
    """Words of plain text, then character pairs, as the index counts them."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    letters = [c for c in text if c.isalnum()]
    return words, [a + b for a, b in zip(letters, letters[1:], strict=False)]


def brute(query):
    """Similarity and raw BM25 of each ticket, by definition."""
    docs = [bag(f"{r['title']}。{r['text']}") for r in ROWS]
    n = len(docs)
    df = Counter(t for w, g in docs for t in set(w + g))
    wdf = Counter(t for w, _ in docs for t in set(w))
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}

    def vector(w, g):
        raw = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(w + g).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values())) or 1
        return {t: v / norm for t, v in raw.items()}

    q = bag(query)
    qv, average = vector(*q), sum(len(w) for w, _ in docs) / n
    out = {}
    for r, (w, g) in zip(ROWS, docs, strict=True):
        dv, tf = vector(w, g), Counter(w)
        bm = sum(math.log(1 + (n - wdf[t] + 0.5) / (wdf[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * (len(w) or 1) / average)) for t in q[0] if tf[t])
        out[r["id"]] = (sum(v * dv.get(t, 0) for t, v in qv.items()), bm)
    return out


def test_recall_matches_the_definition(spark, engine):
    query = "red red lamp"
    want = brute(query)
    got = {r["doc_id"]: r for r in engine.recall(ask(spark, query)).collect()}
    assert len(got) == 4
    for doc, r in got.items():
        assert r["sim"] == pytest.approx(want[doc][0], abs=6e-5)
        assert r["bm25_raw"] == pytest.approx(want[doc][1], abs=6e-4)
        assert r["bm25"] <= 1


def test_pool_is_full_though_nothing_matches(spark, engine):
    got = engine.recall(ask(spark, "zzz", "qqq")).orderBy("qid", "recall_rank").collect()
    assert [(r["qid"], r["doc_id"], r["recall_score"]) for r in got] == [(q, d, 0.0) for q in (0, 1) for d in ("D1", "D2", "D3", "D4")]


def test_rerank_penalises_a_group_said_twice(spark, engine):
    rows = {r["doc_id"]: r for r in engine.rerank(ask(spark, "red lamp"), 4).collect()}
    assert sorted(r["dup_count"] for r in rows.values() if r["grp"] == "G1") == [0, 1]
    for r in rows.values():
        parts = sum(r["contrib"].values()) - 0.08 * r["dup_count"]
        assert r["final_score"] == pytest.approx(parts, abs=5e-4)
        assert r["rank_delta"] == r["recall_rank"] - r["final_rank"]


def test_clause_alignment(spark):
    engine = Retrieval(tables.Corpus.of_tickets(tables.tickets(spark, ROWS)), pool_size=4, markers=(" but ",))
    rows = {r["doc_id"]: r for r in engine.features(ask(spark, "red switch but kettle boils")).collect()}
    assert rows["D3"]["clause"] == 1.0
    assert rows["D1"]["clause"] == -1.0
    assert rows["D1"]["missed_terms"] == ["boils", "but", "kettle"]


def test_bad_arguments(spark, engine):
    with pytest.raises(ValueError):
        engine.rerank(ask(spark, "x"), 0)
    with pytest.raises(ValueError):
        search(engine, "  ")
    with pytest.raises(ValueError):
        Retrieval(engine.corpus, weights={"simm": 1})
    with pytest.raises(ValueError):
        Retrieval(engine.corpus, pool_size=0)


def test_search_modes(spark, engine):
    assert search(engine, "red lamp", 3).count() == 3
    plain = search(engine, "red lamp", 3, rerank=False).collect()
    assert all(r["final_score"] == r["recall_score"] and r["rank_delta"] == 0 and not r["contrib"] for r in plain)
    assert '"pool_size":4' in search_json(engine, "red lamp", 2).first()["json"]


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 1, "X", "t"), (1, 2, "A", "t"), (1, 3, "A", "t"), (1, 4, "B", "t"), (2, 1, "X", "t")], "qid int, rank int, grp string, title string")
    gold = spark.createDataFrame([(1, ["A", "B"]), (2, ["A"]), (3, ["A"])], "qid int, gold array<string>")
    got = {r["qid"]: r for r in metrics.per_query(ranked, gold, (1, 3, 5)).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert got[1]["recall_1"] == 0 and got[1]["recall_3"] == 1 and got[1]["mrr"] == 0.5
    assert got[1]["ndcg_3"] == pytest.approx(1 / math.log2(3) / ideal, abs=1e-6)
    assert got[1]["ndcg_5"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / ideal, abs=1e-6)
    assert got[2]["mrr"] == got[3]["mrr"] == 0
    mean = metrics.evaluate(ranked, gold, (1, 3)).first()
    assert mean["n_queries"] == 3 and mean["mrr"] == pytest.approx(0.1667)
    empty = metrics.evaluate(ranked.limit(0), gold.limit(0), (1,)).first()
    assert empty["n_queries"] == 0 and empty["mrr"] == 0


def test_evaluation_reports(spark, engine):
    queries = ask(spark, "red lamp", "parcel lost")
    gold = spark.createDataFrame([(0, ["G1"]), (1, ["G4"])], "qid int, gold array<string>")
    e = Evaluation(engine, queries, gold)
    assert {r["arm"]: r["recall_1"] for r in e.metrics().collect()} == {"baseline": 1.0, "rerank": 1.0}
    flips = e.flips().first()
    assert flips["n"] + flips["unchanged"] == 2
    assert e.failed().count() == 0
    assert {r["strategy"] for r in strategies(engine, queries, gold).collect()} == {"sim", "rrf", "rerank"}


def test_nearest(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id int, embedding array<double>")
    got = nearest(rows, rows.where("vec_id = 1"), 1).first()
    assert (got["vec_id"], got["cosine"]) == (2, 1.0)


def test_nearest_of_many_queries(spark):
    rows = spark.range(10_001).selectExpr("id as vec_id", "array(1.0D, id % 2) as embedding")
    got = nearest(rows.where("vec_id < 4"), rows, 1).collect()
    assert len(got) == 10_001 and len({r["query_id"] for r in got}) == 10_001
    assert all(r["cosine"] == 1.0 and r["vec_id"] == next(i for i in range(4) if i % 2 == r["query_id"] % 2 and i != r["query_id"]) for r in got)


def test_request_bodies(spark):
    rows = spark.createDataFrame([('{"text": "hi"}',), ('{"text": " "}',), ("{",), ("{}",)], "body string")
    got = {r["body"]: r["error"] for r in tables.from_body(rows).select("body", F.col("error")).collect()}
    assert got == {'{"text": "hi"}': None, '{"text": " "}': "blank text", "{": "bad json", "{}": "blank text"}


def test_holding_any_part(spark):
    """Parts with an inner word, one word, a part that begins another, an empty one; texts that are null or repeated."""
    texts = [(1, "a red lamp is on the table", "s1"), (2, "red", "s2"), (3, None, "s3"), (4, "the  red  lamp", "s4"), (5, "a red lamp is on the table", "s5"), (6, "", None), (7, "x日本語x", "s7")]
    parts = [(0, "red lamp is"), (1, "red"), (2, "red lamp"), (3, ""), (4, "e  re"), (5, "日本"), (6, "lamp is on th"), (7, "nowhere"), (8, None), (9, "red lamp is")]
    docs = spark.createDataFrame(texts, "doc_id int, text string, source string")
    got = {(r["qid"], r["source"]) for r in tables.holding(docs, spark.createDataFrame(parts, "qid int, part string")).collect()}
    assert got == {(q, s) for q, p in parts for _, t, s in texts if p and t and p in t}


def test_postings_are_never_kept_on_disk(engine):
    """Postings take several times the input: what memory doesn't hold is counted anew, in partitions of few documents."""
    assert not engine.index.counts.storageLevel.useDisk and engine.index.docs.storageLevel.useDisk


def test_documents_of_a_partition(spark, monkeypatch):
    from lodestone.operators import index

    monkeypatch.setattr(index, "PARTITION", 10)
    texts = spark.range(95).selectExpr("id as doc_id", "'word ' || id as text")
    made = index.Index.of(texts, F.col("text"))
    assert made.partitions == 10 and made.docs.count() == 95
    made.release()


def test_statistics_of_more_tokens_than_are_broadcast(spark, monkeypatch):
    from lodestone.operators import index

    texts = spark.createDataFrame([(i, " ".join(f"w{j} w{j * i}" for j in range(1, 30) if j % (i % 7 + 1) == 0)) for i in range(60)] + [(3, "w1 again"), (None, "w2 w2")], "doc_id int, text string")
    found = []
    for rows in (index.ROWS, 20):
        monkeypatch.setattr(index, "ROWS", rows)
        made = index.Index.of(texts, F.col("text"))
        assert (index._common(made.found) > 1) == (rows == 20)
        found.append({r["doc_id"]: (r["dl"], round(r["norm"], 9)) for r in made.docs.collect()})
        made.release()
    assert found[0] == found[1] and len(found[0]) == 61


def test_scores_by_matrices_equal_scores_by_rows(spark, engine, monkeypatch):
    from lodestone.operators import retrieval, scoring

    asked = ask(spark, "red red lamp", "kettle lamp 7", "zzz", "", "lamp dark", "the lamp", "a lamp", "no lamp", None)
    monkeypatch.setattr(scoring, "QUERIES", 4)
    columns = ["qid", "doc_id", "sim", "bm25_raw", "bm25", "hit_whole", "hit_head", "hit_tail"]
    by_matrices = sorted(map(tuple, engine.matches(asked, engine.query_tokens(asked)).select(columns).collect()))
    pool = sorted(map(tuple, engine.recall(asked, 2).select("qid", "recall_rank", "doc_id").collect()))
    monkeypatch.setattr(retrieval, "is_small", lambda df: False)
    assert by_matrices == sorted(map(tuple, engine.matches(asked, engine.query_tokens(asked)).select(columns).collect()))
    assert pool == sorted(map(tuple, engine.recall(asked, 2).select("qid", "recall_rank", "doc_id").collect()))


def test_nearest_meets_vectors_by_matrices(spark, monkeypatch):
    """Portions of few vectors, repeated ids, nulls and ties give what every pair's cosine gives, and no join of all pairs is left."""
    from lodestone.functions.numbers import dot, l2_normalize, rounded
    from lodestone.operators import scoring

    monkeypatch.setattr(scoring, "VECTORS", 7)
    data = [(i % 57, [float(i * 7 % 11 - 5), float(i * 3 % 5 - 2), float(i % 4)]) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0])]
    rows = spark.createDataFrame(data, "vec_id int, embedding array<double>")
    asked = rows.where("vec_id % 5 = 0 AND embedding IS NOT NULL")
    got = nearest(rows, asked, 4)
    unit = rows.select("vec_id", l2_normalize(F.col("embedding")).alias("v"))
    pairs = asked.select(F.col("vec_id").alias("query_id"), l2_normalize(F.col("embedding")).alias("q")).join(unit, F.col("query_id") != F.col("vec_id"))
    want = {}
    for r in pairs.select("query_id", "vec_id", rounded(dot(F.col("q"), F.col("v")), 6).alias("c")).where("c IS NOT NULL").collect():
        want.setdefault(r["query_id"], []).append((-r["c"], r["vec_id"]))
    for r in got.collect():
        assert (-r["cosine"], r["vec_id"]) == sorted(want[r["query_id"]])[r["rank"] - 1]
    assert got.count() == 4 * len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


ODD = [
    (1, "Red lamp. The re re lamp 12.5 {a} b_c"), (2, "Änderung größe\u3000ΟΔΟΣ ⅷ x\u0661\u0662 7 日本語，我们的 灯 é"), (3, None), (4, ""), (5, " - "), (6, "x"), (7, "é"), (8, "的"), (9, "𝒳y 𝒳 İstanbul"),
    (3, "red again"), (None, "no id"), (11, "ab\x00c \x85 \u2028d"), (12, "lamp lamp 我 12 12 ١٢ \x1fa" * 3),
]


def test_postings_by_numpy_equal_those_by_rows(spark, monkeypatch):
    """Portions of few documents and bytes, tasks that forget, texts of several scripts, repeated and missing ids."""
    from lodestone.operators import index, postings

    texts = spark.createDataFrame(ODD, "doc_id int, text string")
    for documents, size, most in ((384, 1 << 21, 300_000), (3, 1 << 21, 5), (384, 20, 40)):
        for name, value in (("DOCUMENTS", documents), ("BYTES", size), ("MOST", most)):
            monkeypatch.setattr(postings, name, value)
        for char_ngram in (True, False):
            made = index.Index.of(texts, F.col("text"), char_ngram)
            by_rows = index.frequencies(made.counts)
            want = {r["t"]: (r["df"], r["wdf"]) for r in by_rows.collect()}
            if not char_ngram:
                assert {"red", "12.5", "#12", "{a", "gr", "größe"[2:4], "日本", "#١٢"} <= set(want)
            rows = postings.packed(texts, F.col("text"), False)
            assert {r["t"]: (r["df"], r["wdf"]) for r in made.found.collect()} == want
            assert sorted(map(str, rows.select("doc_id").collect())) == sorted({str(r) for r in texts.select("doc_id").collect()})
            stats = index.statistics(made.counts, made.found, made.vocab, 2).collect()
            assert {r["doc_id"]: (r["dl"], round(r["norm"], 9)) for r in made.docs.collect()} == {r["doc_id"]: (r["dl"], round(r["norm"], 9)) for r in stats}
            known = dict(zip(made.known[0].tolist(), made.known[1].tolist(), strict=True))
            assert known == {int.from_bytes(postings.hashed(t)): df for t, (df, _) in want.items() if df > 1}
            assert made.average() == pytest.approx(sum(r["dl"] for r in stats) / len(ODD))
            made.release()


def test_search_makes_no_rows_of_postings(spark, engine):
    """Neither postings nor all that made the pool's scores are in the plans that use them."""
    plan = lambda df: df._jdf.queryExecution().toString()
    asked = ask(spark, "red lamp")
    assert "posexplode" not in plan(engine.matches(asked, engine.query_tokens(asked)))
    assert "posexplode" not in plan(engine.recall(asked)) and "InMemory" not in plan(engine.recall(asked))


def test_best_rows_of_a_task():
    """What is held stays within bounds, and ties go to the smaller id whenever it comes."""
    import numpy as np
    import pyarrow as pa

    from lodestone.operators.scoring import Best

    rng = np.random.default_rng(5)
    best, rows = Best(3, 4), []
    for ids in np.array_split(rng.permutation(900), 60):
        q, score = rng.integers(0, 4, len(ids)), rng.integers(0, 6, len(ids)) / 4
        rows += list(zip(q.tolist(), (-score).tolist(), ids.tolist(), strict=True))
        kept = score >= best.least[q]
        best.add(pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (q, ids, score)], ["q", "doc_id", "score"]))
        assert sum(x.num_rows for x in best.held) <= best.most
    got = [(r["q"], -r["score"], r["doc_id"]) for r in best.rows().to_pylist()]
    assert got == [x for q in range(4) for x in sorted(r for r in rows if r[0] == q)[:3]]


def test_chosen_documents(spark, sf_dir):
    corpus = tables.Corpus.of_documents(spark, sf_dir)
    ids = corpus.docs.where("doc_id % 7 = 0").select("doc_id")
    assert sorted(map(str, corpus.chosen(ids).collect())) == sorted(map(str, corpus.docs.where("doc_id % 7 = 0").collect()))
    assert corpus.plain.columns == ["doc_id", "title", "text"] and corpus.plain.count() == corpus.docs.count()
