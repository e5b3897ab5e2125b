import random

import corpus_pipeline as c
from polyspark.llm import similar_documents as s
from polyspark.llm.sentencepiece_codec import Codec, load_vocabulary
from tests.llm.conftest import components, words


def shingles(text, n=5):
    w = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def kept(rows):
    sets = [shingles(t) for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or (sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    root = components(len(rows), edges)
    best = {}
    for (i, _), r in zip(rows, root):
        best[r] = min(best.get(r, s.NO_ID), s.NO_ID if i is None else i)
    return sorted(best.values())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark, docs, none, monkeypatch):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [words(rng, 300) for _ in range(12)]
    rows += [(1000 + i, edited(rng, base[i % 12], 1 + i % 3)) for i in range(120)] + [(2000 + i, words(rng, rng.randint(5, 200))) for i in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = kept(rows)
    got = sorted(s.NO_ID if r.doc_id is None else r.doc_id for r in s.keep_one(table).collect())
    assert got == want
    # every candidate through the forests, blocks and cells
    monkeypatch.setattr(s, "FEW", 0)
    monkeypatch.setattr(s, "SET_BLOCK", 4)
    monkeypatch.setattr(s, "candidates", lambda *a, f=s.candidates: f(*a, block=3))
    got = sorted(s.NO_ID if r.doc_id is None else r.doc_id for r in s.keep_one(table).collect())
    assert got == want
    assert s.keep_one(docs).columns == docs.columns and s.keep_one(none).count() == 0


def test_a_line_repeated_different_numbers_of_times(spark):
    rng = random.Random(6)
    rows = []
    for k in range(12):
        body, line = words(rng, 304), words(rng, 24)
        rows += [(2 * k, f"{body}\n{line}"), (2 * k + 1, body + f"\n{line}" * 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = kept(rows)
    assert len(want) == 12
    assert sorted(r.doc_id for r in s.keep_one(table).collect()) == want


def test_no_pair_at_the_threshold_is_missed(spark):
    rng = random.Random(7)
    rows = []
    for k in range(400):
        text = words(rng, 104)
        # blocks of words after the text: 100 shingles and up to 25 more, Jaccard 0.80 to 0.85
        rows += [(2 * k, text), (2 * k + 1, text + " " + words(rng, 18 + k % 8))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = kept_pairs(rows)
    assert len(want) == 400
    assert sorted(r.doc_id for r in s.keep_one(table).collect()) == want


def test_sketches_drop_no_true_pair_and_most_others(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    rows, truth = [], []
    for k in range(600):
        n, common = int(rng.integers(1, 1500)), rng.choice([0.5, 0.8, 0.9, 1.0])
        both = rng.integers(-(1 << 63), 1 << 63, n)
        rest = int((1 - common) * n / (1 + common)) if common >= 0.8 else n
        x = np.unique(np.concatenate([both, rng.integers(-(1 << 63), 1 << 63, rest)]))
        y = np.unique(np.concatenate([both, rng.integers(-(1 << 63), 1 << 63, int(rest * rng.random()))]))
        inter = len(np.intersect1d(x, y))
        rows.append((k, len(x), len(y), s.sketch(x).tolist(), s.sketch(y).tolist()))
        truth.append(inter / (len(x) + len(y) - inter))
    table = spark.createDataFrame(rows, "k int, n int, m int, x array<long>, y array<long>")
    stay = {r.k for r in table.filter(s._may_be_similar(0.8)).collect()}
    alike, far = ({k for k, j in enumerate(truth) if ok(j)} for ok in (lambda j: j >= 0.8, lambda j: j < 0.6))
    assert len(alike) > 200 and alike <= stay and len(far) > 80 and len(far & stay) < 0.2 * len(far)


def kept_pairs(rows):
    """Like ``kept`` where only neighbours can be alike."""
    return sorted(x for k in range(0, len(rows), 2) for x in kept(rows[k : k + 2]))


def test_stages(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = at.columns
    codec = Codec(load_vocabulary())
    for k, (name, stage) in enumerate(c.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(c.STAGES) - 1:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{name}")
            before, at = at, spark.read.parquet(f"{tmp_path}/{name}")
    texts = sorted(r.text for r in at.collect())
    final = c.run(spark, str(tmp_path)).collect()
    assert all(r.round_trip for r in final) and sorted(codec.decode(r.ids) for r in final) == texts


def test_empty_table(spark, none, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_helper_names_of_the_table_stay(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, 1, 2, 3, 4), (1, text, 1, 2, 3, 4), (2, text + " end", 5, 6, 7, 8), (3, "other " * 9, 9, 9, 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, __th int, __n int, __copy int")
    got = s.keep_one(df).collect()
    assert sorted((r.doc_id, r["__id"], r["__th"], r["__n"], r["__copy"]) for r in got) == [(1, 1, 2, 3, 4), (3, 9, 9, 9, 9)]


def test_fingerprints_link_what_jaccard_does_not(spark):
    """Links of op2, of Jaccard, and a group that only both together connect."""
    from polyspark.llm import simhash

    rng = random.Random(9)
    line = words(rng, 9)
    by_print = [f"{line}\n" * 60 + words(rng, 20) for _ in range(3)]
    w = words(rng, 60)
    alike = [by_print[2] + " " + words(rng, 2), w, w + " " + words(rng, 6)]
    texts = by_print + alike + [words(rng, 40)]
    fp = [simhash.fingerprint(simhash.shingle_hashes(t, 3)) % 2**64 for t in texts]
    sets = [shingles(t) for t in texts]
    jaccard = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    near = lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3
    assert near(0, 1) and jaccard(0, 1) < 0.5 and jaccard(4, 5) > 0.8 and not near(4, 5)
    n = len(texts)
    root = components(n, [(i, j) for i in range(n) for j in range(i) if near(i, j) or jaccard(i, j) >= 0.8])
    table = spark.createDataFrame([(10 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in c.near_duplicates(spark, table, "").collect()) == sorted({10 + r for r in root})


def test_keys_of_many_classes_are_found_in_chunks(spark, monkeypatch):
    heads = spark.createDataFrame([(i, [1, 100 + i, 2 if i < 4 else 200 + i]) for i in range(40)], "sd long, head array<long>").repartition(3)
    monkeypatch.setattr(s, "CHUNK", 30)
    assert {r.key: r.cells for r in s.hot_keys(heads, 120, 16).collect()} == {1: 3}
    assert s.hot_keys(heads, 120, 8192).isEmpty()
