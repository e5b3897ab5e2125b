import re

import xxhash

from polyspark.llm import simhash
from tests.llm.conftest import components


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check(docs, **kw):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicates(docs, **kw).collect()
    want = [brute(r.text) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if bin(want[i] ^ want[j]).count("1") <= 3]
    # components of the smallest id
    root = components(len(rows), edges)
    smallest = {}
    for k, r in zip(root, rows):
        if r.doc_id is not None:
            smallest[k] = min(smallest.get(k, r.doc_id), r.doc_id)
    expected = sorted((str(r.doc_id), f, str(smallest.get(k))) for r, f, k in zip(rows, want, root))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == expected


def test_against_brute_force(docs):
    check(docs)


def test_links_lead_through_rows_without_id(spark, monkeypatch):
    """0 and 63 differ in six bits, 7 lies between them; nothing near ``far`` has an id."""
    far = 0x5555555555555555
    rows = [(1, 0), (None, 7), (2, 63), (None, far), (None, far - 1), (5, -1), (3, -2)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words: prints)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(prints).collect()), key=repr)
    assert got == sorted([(1, 0, 1), (None, 7, 1), (2, 63, 1), (None, far, None), (None, far - 1, None), (5, -1, 3), (3, -2, 3)], key=repr)


def test_hot_keys_are_split(spark, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(200)) + f" tail{i}") for i in range(120)] + [(200 + i, f"other {i} text {i * 7}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = simhash.fingerprints(docs).select("fp").distinct()
    whole = {tuple(sorted((r.fp_a, r.fp_b))) for r in simhash.links(prints, 3).collect()}
    split = {tuple(sorted((r.fp_a, r.fp_b))) for r in simhash.links(prints, 3, block=8).collect()}
    fps = sorted(r.fp for r in prints.collect())
    at = {f: i for i, f in enumerate(fps)}
    m = (1 << 64) - 1
    every = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & m).count("1") <= 3]
    assert every
    for found in (whole, split):
        assert all(bin((a ^ b) & m).count("1") <= 3 for a, b in found)
        assert components(len(fps), [(at[a], at[b]) for a, b in found]) == components(len(fps), every)
    check(docs)


def test_thresholds_sum_up():
    costs = [[0.0, 1.0, 50.0, 1e4], [0.0, 5.0, 40.0, 1e4], [0.0, 2.0, 90.0, 1e4]]
    got = simhash.allocate(costs, 1)
    assert sum(got) == 1 and len(got) == 3


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
