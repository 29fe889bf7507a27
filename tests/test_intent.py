import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import intent, train
from lodestone.operators.augment import augment
from lodestone.plans.intent import Classifier, cross_validate, featured, grid_search
from lodestone.sources import tables

CORPUS = {
    "refund": ["give my money back", "refund the money please", "money back for this order", "I want a refund"],
    "parcel": ["where is my parcel", "parcel is late", "the parcel never came", "track my parcel"],
    "human": ["let me talk to someone", "a person please", "talk to a person", "someone real"],
}
NAMES = list(CORPUS)


@pytest.fixture(scope="module")
def examples(spark):
    rows = tables.labelled(spark, CORPUS, NAMES)
    return rows.selectExpr("cast(abs(hash(text)) as bigint) as doc_id", "text", "label_id")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "label_id int, label string")


def test_keywords(spark, examples, labels):
    model = intent.Keywords.fit(examples, labels, top_per_class=3)
    assert model.table.groupBy("label_id").count().where("count > 3").isEmpty()
    texts = spark.createDataFrame([(1, "my parcel is where"), (2, "zzz"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in intent.predictions(model.probabilities(texts), labels).collect()}
    assert got[1]["label"] == "parcel"
    for i in (2, 3, 4):  # nothing hit: all the same, the first label wins
        assert got[i]["pred"] == 0 and got[i]["confidence"] == pytest.approx(1 / 3, abs=1e-4) and got[i]["margin"] == 0


@pytest.mark.parametrize(("confidence", "margin", "wanted"), [(0.7, 0.35, "auto"), (0.7, 0.3499, "assist"), (0.6999, 0.9, "assist"), (0.45, 0.0, "assist"), (0.4499, 0.4, "human")])
def test_policy(spark, confidence, margin, wanted):
    row = spark.createDataFrame([(confidence, margin)], "c double, m double")
    assert row.select(intent.action(F.col("c"), F.col("m"))).first()[0] == wanted


def test_report(spark, labels):
    judged = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (0, 1)], "pred int, label_id int")
    rows = {r["label"]: r for r in intent.class_report(judged, labels).collect()}
    assert (rows["refund"]["precision"], rows["refund"]["recall"], rows["refund"]["support"]) == (0.6667, 0.6667, 3)
    assert (rows["human"]["f1"], rows["human"]["support"]) == (0.0, 0)
    s = intent.summary(judged, labels).first()
    assert s["accuracy"] == 0.5 and s["macro_f1"] == pytest.approx(0.2222)
    matrix = {(r["truth"], r["predicted"]): r["n"] for r in intent.confusion(judged, labels).collect()}
    assert len(matrix) == 9 and matrix[0, 0] == 2 and matrix[2, 2] == 0
    assert intent.summary(judged.limit(0), labels).first()["ci_high"] == 1.0


def test_folds_are_even(examples):
    sizes = {(r["label_id"], r["fold"]): r["count"] for r in intent.folds(examples, 4).groupBy("label_id", "fold").count().collect()}
    assert set(sizes.values()) == {1} and len(sizes) == 12


def test_augment(examples):
    first, again = (sorted(map(tuple, augment(examples, synonyms=(("money", "cash"),)).collect())) for _ in range(2))
    assert first == again
    texts = [t for _, _, t, _ in first]
    assert len(set(texts)) == len(texts) > 12 and any("cash" in t for t in texts)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.random((6, 5)), np.array([0, 1, 2, 0, 1, 2])
    for hidden in (0, 4):
        net = train.Net(5, 3, hidden=hidden, l2=0.0)
        got, _ = net._gradients(x, y)
        for p, g in zip(net.params, got, strict=True):
            for at in list(np.ndindex(p.shape))[:6]:
                loss = []
                for step in (1e-6, -1e-6):
                    p[at] += step
                    loss.append(-np.log(net.probabilities(x)[np.arange(6), y]).mean())
                    p[at] -= step
                assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-5)


def test_adam_leaves_untouched_coordinates_alone():
    p = [np.ones(3)]
    adam = train.Adam(p, 0.1)
    adam.step([np.array([1.0, 0.0, -1.0])])
    assert p[0].tolist() == pytest.approx([0.9, 1.0, 1.1])
    moment = adam.m[0].copy()
    adam.step([np.array([0.0, 1.0, 0.0])])
    assert adam.m[0][0] == moment[0] and p[0][0] == pytest.approx(0.9)


def test_dimensions_are_checked():
    with pytest.raises(ValueError):
        train.Net(4, 2).fit(np.zeros((2, 3)), np.array([0, 1]))


def test_models_learn(spark, examples, labels):
    model = Classifier(examples, labels, quick=True)
    rows = {r["model"]: r for r in model.report(examples).collect()}
    assert rows["logreg"]["accuracy"] > 0.9 and rows["mlp"]["accuracy"] > 0.9
    assert len(model.nets["logreg"].history) == 9 and model.nets["logreg"].history[-1]["loss"] < model.nets["logreg"].history[0]["loss"]
    one = model.classify(spark.createDataFrame([(1, "parcel is late")], "doc_id bigint, text string")).collect()
    assert {r["model"] for r in one} == {"keyword", "logreg", "mlp"} and {r["label"] for r in one} == {"parcel"}


def test_cross_validation_and_grid(examples):
    got = {r["model"]: r for r in cross_validate(examples, 3, k=2, epochs=5).collect()}
    assert set(got) == {"logreg", "mlp"} and all(len(r["folds"]) == 2 and 0 <= r["mean"] <= 1 for r in got.values())
    cells = grid_search(examples, examples, 3, epochs=(5, 5)).collect()
    assert len(cells) == 10


def test_every_held_out_row_is_judged(spark, monkeypatch):
    from lodestone.plans import queries

    rows = [(i, ("give my money back", "where is my parcel")[i % 2] + f" x{i}", i % 2) for i in range(600)]
    rows = spark.createDataFrame(rows, "doc_id bigint, text string, label_id int")
    # One in 100 rows has the other class's text.
    rows = rows.withColumn("label_id", F.when(F.col("doc_id") % 100 == 0, 1 - F.col("label_id")).otherwise(F.col("label_id")))
    for r in cross_validate(rows, 2, epochs=5, sample=20).collect():
        assert r["mean"] == pytest.approx(0.99, abs=1e-4) and len(r["folds"]) == 4
    seen = []
    monkeypatch.setattr(queries.train, "judged", lambda held, nets, f=train.judged: (seen.append(held.count()), f(held, nets))[1])
    monkeypatch.setattr(queries, "examples", lambda *_: rows)
    queries.cross_validation(spark, "").collect()
    assert seen == [480]  # the whole training part, each row in the fold that has it


def test_scale_path(examples):
    model = train.at_scale(featured(examples).select("doc_id", "tokens", "label_id"), features=1 << 12)
    assert model.transform(featured(examples)).where("prediction = label_id").count() >= 10


def test_streaming(spark, examples, labels, tmp_path):
    from lodestone.streaming.classify import classify_into, tokens

    spark.createDataFrame([(1, "where is my parcel"), (2, "refund please")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in"))
    assert "tokens" in tokens(stream).columns
    classify_into(stream, intent.Keywords.fit(examples, labels), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["doc_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "parcel", 2: "refund"}
