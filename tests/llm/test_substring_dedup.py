import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from polyspark.llm import substring_dedup as s
from polyspark.llm.fm_index import FMIndex, WaveletMatrix, suffix_array
from tests.llm.conftest import words


def brute(texts, window=35):
    split = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept.decode()))
    return out


def same(docs, **kw):
    rows = docs.select("doc_id", "text").collect()
    got = s.remove_repeats(docs, **kw).collect()
    want = brute([r.text for r in rows])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ((r.doc_id, *x) for r, x in zip(rows, want))))


def test_against_brute_force(docs):
    same(docs)


def test_planted_passages(spark):
    rng = random.Random(9)
    passages = [words(rng, n) for n in (34, 35, 36, 80, 200)]
    texts = [" ".join([words(rng, rng.randint(0, 50)), rng.choice(passages), words(rng, rng.randint(0, 50)), rng.choice(passages)]) for _ in range(60)]
    texts += ["x " * 500, "a b " * 100 + words(rng, 40), words(rng, 3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    same(docs)
    # minimizers with many different segments take the other way
    same(docs, hot_segments=1)


def test_digest(spark):
    docs = spark.createDataFrame([(1, "a  b\nc")], "doc_id long, text string")
    assert s.remove_repeats(docs, digest=True).first().kept_sha256 == hashlib.sha256(b"a b c").hexdigest()


def test_index():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 5, 300)
    order = suffix_array(text)
    assert order.tolist() == sorted(range(300), key=lambda i: text[i:].tolist())
    w = WaveletMatrix(text, 5)
    for c in range(5):
        at = np.arange(301)
        assert (w.rank(np.full(301, c), at) == np.concatenate([[0], np.cumsum(text == c)])).all()
    x = FMIndex(np.append(text + 1, 0), 7)
    for _ in range(50):
        i, n = rng.integers(0, 295), rng.integers(1, 5)
        lo, hi = x.first(np.array([text[i + n - 1] + 1]))
        for k in range(n - 2, -1, -1):
            lo, hi = x.extend(np.array([text[i + k] + 1]), lo, hi)
        assert hi[0] - lo[0] == sum((text[j : j + n] == text[i : i + n]).all() for j in range(300 - n + 1))


def test_empty_table(none):
    assert s.remove_repeats(none).count() == 0


def test_text_of_more_words_than_a_block(spark):
    rng = random.Random(11)
    long = [f"{rng.getrandbits(24):x}" for _ in range(1_200_000)]
    passage = [f"p{k}" for k in range(100)]
    # one over the border of two blocks, one in a short text, one of fewer words than a window
    long[s.SLICE - 40 : s.SLICE + 60] = passage
    short = ["before", *passage, "after"]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(passage[:34]))], "doc_id long, text string")
    got = {r.doc_id: r for r in s.remove_repeats(docs).collect()}
    assert (got[1].n_words, got[1].n_removed) == (1_200_000, 100)
    assert got[1].kept_text == " ".join(long[: s.SLICE - 40] + long[s.SLICE + 60 :])
    assert (got[2].n_removed, got[2].kept_text, got[3].n_removed) == (100, "before after", 0)


def test_blocks_have_each_window_once(monkeypatch, texts):
    import pyarrow as pa

    monkeypatch.setattr(s, "SLICE", 100)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, "word " * 700], pa.string())})
    seen, want = Counter(), Counter()
    for b, h in s._pieces([batch]):
        for d, at, n in zip(h.doc.tolist(), h.at.tolist(), h.count.tolist()):
            seen.update((b.column("text")[d].as_py(), at + k) for k in range(n))
    for t in [*texts, "word " * 700]:
        want.update((t, k) for k in range(len((t or "").encode().split()) - s.WINDOW + 1))
    assert seen == want


def test_equal_rows_bring_their_segments_once(spark):
    """5000 equal rows and as many without an id: each row meets the segments of one text, not those of all its copies."""
    text = " ".join(f"w{k}" for k in range(200))
    docs = spark.range(10_000).select(F.when(F.col("id") < 5000, F.lit(7)).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    other = spark.createDataFrame([(None, " ".join(f"v{k}" for k in range(100)))], "doc_id long, text string")
    docs = docs.unionByName(other).repartition(4)
    found = s.repeated(docs.select("doc_id", "text", F.xxhash64("text").alias("th"))).select(F.size("found").alias("n")).collect()
    assert len(found) == 2 and all(r.n < 20 for r in found)
    rows = s.remove_repeats(docs).groupBy("n_words", "n_removed").count().collect()
    assert sorted((r.n_words, r.n_removed, r["count"]) for r in rows) == [(100, 0, 1), (200, 200, 10_000)]
