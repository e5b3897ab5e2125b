import hashlib
import zlib

import duckdb
import pytest

from polyspark.llm import merkle as m


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves: list[str]) -> tuple[str, list[list[str]]]:
    """The root, and the siblings of every leaf from left to right, level by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            proofs[k] += [x for j, x in enumerate(nodes[run : run + 3], run) if j != i]
        nodes = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], proofs


def fields(r, text) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute(rows) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, fields(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = brute_tree([x[2] for x in groups[s]])
    root, upper = brute_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, upper):
        for (_, _, leaf, r), proof in zip(groups[s], trees[s][1]):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            same = not (tampered and r.text is not None and "\n" in r.text)
            out.append((r.doc_id, leaf, trees[s][0], root, h(*proof, *up), same))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def took(df):
    rows = df.collect()
    assert all(r.verified == (r.folded_root == r.root) for r in rows)
    return ordered((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in rows)


@pytest.fixture
def write(tmp_path):
    def run(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return run


@pytest.mark.parametrize("local,climb", [(7, 6), (1, 1)])
def test_as_brute_force(spark, docs, write, monkeypatch, local, climb):
    monkeypatch.setattr(m, "LOCAL", local)
    monkeypatch.setattr(m, "CLIMB", climb)
    monkeypatch.setattr(m, "LEAVES_PER_TASK", 7)
    at = write(docs)
    assert took(m.query(spark, at)) == ordered(brute(spark.read.parquet(f"{at}/documents.parquet").collect()))


def test_whole_table(spark):
    at = "/root/testdata/sf0.01"
    assert took(m.query(spark, at)) == ordered(brute(spark.read.parquet(f"{at}/documents.parquet").collect()))


@pytest.mark.parametrize("sizes", [[1], [4, 1, 3], [27, 28, 26], [1] * 30])
def test_shapes(spark, write, monkeypatch, sizes):
    """Trees of one leaf, of whole and of ragged levels, one or many groups; small runs so that ranges cut through subtrees."""
    monkeypatch.setattr(m, "LOCAL", 2)
    monkeypatch.setattr(m, "CLIMB", 2)
    monkeypatch.setattr(m, "LEAVES_PER_TASK", 5)
    rows = [(k * 1000 + i, f"t\n{i}", None, f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    at = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    assert took(m.query(spark, at)) == ordered(brute(spark.read.parquet(f"{at}/documents.parquet").collect()))


def test_equal_rows_are_split(spark, write, monkeypatch):
    """Half of all rows are one repeated row: its ranges are cut as well."""
    monkeypatch.setattr(m, "LEAVES_PER_TASK", 50)
    rows = [(i, "x", "en", "a", 1) for i in range(300)] + [(7, "x" * 200_000, "en", "a", 1)] * 300
    at = write(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert took(m.query(spark, at)) == ordered(brute(spark.read.parquet(f"{at}/documents.parquet").collect()))


def test_empty_table(none, write, spark):
    at = write(none)
    assert m.query(spark, at).count() == 0


def test_carried_names_do_not_clash(spark):
    rows = spark.createDataFrame([(i, "s", h(str(i)), i, i) for i in range(5)], "g int, source string, leaf string, level int, o0 int")
    got = m.prove(rows, "source", ["g"], "leaf", ["g", "level", "o0"])
    assert got.columns == ["g", "level", "o0", "leaf", "index", "subroot", "root", "path"]
    assert [r["index"] for r in sorted(got.collect())] == list(range(5))


def test_same_as_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    got = m.query(spark, at)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({m.SQL})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
