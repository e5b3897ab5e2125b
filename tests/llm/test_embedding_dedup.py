import numpy as np
import pytest

from polyspark.llm import embedding_dedup as e
from tests.llm.conftest import components


def brute(rows, least=0.93):
    ok = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    pairs = []
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    pairs.append((i, j))
    return pairs


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in range(4):
        centers = rng.standard_normal((12, 16))
        for c in centers:
            for _ in range(rng.integers(1, 9)):
                rows.append([c + rng.standard_normal(16) * 0.12, label])
    rows = [(10 + i, [float(np.float32(x)) for x in v], int(label)) for i, (v, label) in enumerate(rows)]
    rows += [(900, rows[0][1], rows[0][2]), (901, rows[0][1], rows[0][2]), (902, rows[0][1], None), (903, None, 1), (904, [0.0] * 16, 1), (905, [float("nan")] * 16, 1),
             (906, [None] * 16, 1), (907, [float("inf")] * 16, 1), (908, [], 1), (909, rows[0][1][:8], rows[0][2])]
    got = {r.vec_id: r for r in e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    pairs = brute(rows)
    root = components(len(rows), pairs)
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (degree[i], rows[root[i]][0], root[i] == i)


def test_whole_table(spark):
    """No two vectors of a label are close there, so nothing may be linked."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sum(r.n_links for r in e.query(spark, "/root/testdata/sf0.01").collect()) == 2 * len(brute(rows))


def planted(rng, n, pairs, shared, dim=64):
    """``n`` vectors with a mean cosine of ``shared``, and as many pairs just over the threshold, apart from all others."""
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal(dim))
    across = lambda k: unit(rng.standard_normal((k, dim)))
    x = np.sqrt(shared) * base + np.sqrt(1 - shared) * across(n)
    first, other = unit(x[:pairs]), across(pairs)
    other = unit(other - (other * first).sum(axis=1, keepdims=True) * first)
    twin = 0.935 * first + np.sqrt(1 - 0.935**2) * other
    return np.vstack([unit(x), twin])


@pytest.mark.parametrize("shared", [0.5, 0.8])
def test_sparse_pairs_of_a_label_with_a_direction(spark, monkeypatch, shared):
    """Pairs that no dense group holds together, in a label whose vectors have much in common: found by the passes alone."""
    x = planted(np.random.default_rng(3), 12_000, 400, shared).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((x[k : k + 2000] @ x.T >= 0.93).sum()) for k in range(0, len(x), 2000)) - len(x)
    assert want >= 800
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(4)
    monkeypatch.setattr(e, "EXACT_LABEL", 0)
    got = e.near_duplicates(rows).agg({"n_links": "sum"}).first()[0]
    assert 0.98 * want <= got <= want


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert e.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = e.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (None, None, None), (4, [1.0, 2.0], 1)], schema)).collect()
    assert sorted((r.vec_id or -1, r.n_links) for r in got) == [(-1, 0), (-1, 0), (4, 0)]


def test_dense_groups_miss_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = []
    for label, size in enumerate((500, 3000)):
        center = rng.standard_normal(64)
        group = center + rng.standard_normal((size, 64)) * 0.22
        rows += [(v, label) for v in (*group, *rng.standard_normal((400, 64)))]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    want = np.zeros(len(rows), np.int64)
    for label in (0, 1):
        at = np.array([i for i, r in enumerate(rows) if r[2] == label])
        x = np.array([rows[i][1] for i in at])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want[at] = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert want.max() > 2000
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    # labels compared whole, then the passes with their components compared whole
    for most in (e.EXACT_LABEL, 0):
        monkeypatch.setattr(e, "EXACT_LABEL", most)
        got = {r.vec_id: r.n_links for r in e.near_duplicates(table).collect()}
        assert [got[i] for i in range(len(rows))] == want.tolist()


def test_every_size_goes_through_the_passes(spark, monkeypatch):
    """Links of small labels come from the passes too: there are none where the passes find none."""
    x = planted(np.random.default_rng(4), 300, 100, 0.2)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    total = lambda: e.near_duplicates(table).agg({"n_links": "sum"}).first()[0]
    assert total() == 200
    monkeypatch.setattr(e, "links", lambda vectors, *a: spark.createDataFrame([], "a long, b long"))
    assert total() == 0
