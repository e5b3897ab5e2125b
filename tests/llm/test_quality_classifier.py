import zlib

from polyspark.llm import quality_classifier as q

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = q.query(spark, SF).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").toPandas()
    assert len(got) > 500
    truth, score = got["quality"].to_numpy(), got["score"].to_numpy()
    order = score.argsort().argsort() + 1
    pos = truth == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.85 and ((score >= 0.5) == pos).mean() > 0.85
    assert docs.count() == q.query(spark, SF).count()


def test_cases(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60)] + [(5, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    got = q.score(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len({r.score for r in got if r.doc_id == 20}) == 1
    empty = labels.filter("false")
    assert {r.score for r in q.score(docs, q.fit(docs, empty)).collect()} == {0.5}
    assert q.score(none, q.fit(none, labels)).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", q.F.when(q.held_out(q.F.col("doc_id")), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    a, b = (q.score(docs, q.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_vote_against_brute_force(spark, texts):
    import math

    import numpy as np

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    for i, t in enumerate(texts):
        at, n = q.features(t)
        count = np.zeros(q.FEATURES)
        for a, k in zip(at.tolist(), n.tolist()):
            count[a] += k
        if not count.any():
            assert math.isclose(got[i], float(model["prior"]), abs_tol=1e-6)
            continue
        x = np.sqrt(count / count.sum()) * model["idf"]
        z = (x / math.sqrt(sum(v * v for v in x))) @ model["axes"]
        z = z / math.sqrt(sum(v * v for v in z))
        cos = [float(sum(a * b for a, b in zip(z, v))) for v in model["vectors"]]
        order = sorted(range(len(cos)), key=lambda k: -cos[k])
        near = order[: q.NEIGHBOURS]
        # equal vectors at the border of the neighbours may stand for each other
        if len(order) > len(near) and cos[near[-1]] - cos[order[len(near)]] < 1e-5:
            continue
        weight = [max(cos[k], 1e-6) ** q.POWER for k in near]
        assert math.isclose(got[i], sum(w * model["labels"][k] for w, k in zip(weight, near)) / sum(weight), abs_tol=1e-3)


def test_whole_words_count():
    assert q._features_of("a-" * 60 + "x") != q._features_of("a-" * 60 + "9")
