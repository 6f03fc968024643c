"""The ordinal model: gradients, order of grades, held-out accuracy, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from eventflow.llm import quality
from eventflow.llm.queries import grades

from .samples import AWKWARD, docs


def made(n, seed):
    """Texts whose share of good words follows the grade."""
    random = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        grade = int(random.integers(3))
        words = [("bad", "dull", "fine")[grade] + str(random.integers(6)) for _ in range(4)] + [f"w{x}" for x in random.integers(0, 300, 30)]
        rows.append((i, " ".join(random.permutation(words)), grade))
    return rows


def test_model_orders_grades_and_generalises():
    rows = made(1200, 1)
    hashed = [np.array([quality.bucket(f) for f in quality.features(t)]) for _, t, _ in rows]
    wanted = np.array([g for _, _, g in rows])
    model = quality.fit_rows(hashed[:800], wanted[:800], 3)
    assert (np.diff(model.thresholds) > 0).all()
    table = np.zeros(quality.BUCKETS)
    table[model.buckets] = model.weights
    tails = model.tails(np.array([table[h].sum() for h in hashed[800:]]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (np.round(tails.sum(axis=1)) == wanted[800:]).mean() > 0.95


def test_scores_do_not_depend_on_the_worker_memo(spark, monkeypatch):
    rows = made(300, 2)
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    model = quality.fit(table, ratings, 3)
    weights = np.zeros(quality.BUCKETS, np.float32)
    weights[model.buckets] = model.weights
    monkeypatch.setattr(quality, "MEMO_WORDS", 5)
    for r in quality.rate(table, model, 2).collect():
        text = rows[r.doc_id][1]
        score = sum(float(weights[quality.bucket(f)]) for f in quality.features(text))
        assert abs(r.score - score) < 1e-6
        tails = model.tails(np.array([score]))[0]
        assert abs(r.expected_grade - tails.sum()) < 1e-6 and abs(r.tail - tails[1]) < 1e-6
        assert r.kept == (r.tail >= quality.CUT)


def test_awkward_rows(spark):
    table = docs(spark, AWKWARD)
    ratings = spark.createDataFrame([(1, 2), (1, 2), (2, 0), (None, 1), (9, None), (4, 7), (777, 1)], "doc_id long, grade int")
    model = quality.fit(table, ratings, 3)
    rated = quality.rate(table, model, 2)
    assert rated.columns == ["doc_id", "score", "expected_grade", "tail", "kept"]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rated.collect()) == sorted((i is None, i or 0) for i, _ in AWKWARD)
    assert rated.where("score IS NULL OR tail IS NULL").count() == 0
    assert quality.accepted(table, model, 2).schema == table.schema
    assert quality.rate(docs(spark, []), model, 2).count() == 0


def test_nothing_rated_keeps_everything(spark):
    table = docs(spark, AWKWARD)
    model = quality.fit(table, spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert quality.rate(table, model, 2).where("kept").count() == len(AWKWARD)
    assert quality.accepted(table, model, 2).count() == len(AWKWARD)


def test_sample_is_bounded(spark):
    rows = made(200, 3)
    table = spark.createDataFrame([(i % 20, t) for i, t, _ in rows], "doc_id long, text string")  # repeated ids
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, grade int")
    few = quality.fit(table, ratings, 3, sample=10)
    again = quality.fit(table.repartition(3), ratings, 3, sample=10)
    assert np.array_equal(few.buckets, again.buckets) and np.allclose(few.weights, again.weights)


def test_toxic_documents_go_and_good_ones_stay(spark):
    folder = "/root/testdata/sf0.1"
    table, rated = spark.read.parquet(f"{folder}/documents.parquet"), grades(spark.read.parquet(f"{folder}/labels.parquet"))
    train, held = rated.where("doc_id % 4 <> 0"), rated.where("doc_id % 4 = 0")
    result = quality.rate(table, quality.fit(table, train, 3), 2).join(held, "doc_id")
    kept = {r.grade: r.share for r in result.groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[0] < 0.05 and kept[1] < 0.1 and kept[2] > 0.99
