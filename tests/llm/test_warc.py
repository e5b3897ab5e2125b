import base64
import glob
import gzip
import hashlib

import duckdb
import pytest

from polyspark.llm import warc as w

SCHEMA = "page_id long, url string, html string, digest string, payload int"


def b32(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows) -> list[tuple]:
    """``page_id, bytes, digest, type, refers_to``: of equal payloads the smallest id (null last) is the response, once."""
    best, done, out = {}, set(), []
    key = lambda r: (r.page_id is None, r.page_id or 0)
    for r in rows:
        best[r.html or ""] = min(best.get(r.html or "", key(r)), key(r))
    for r in rows:
        p = r.html or ""
        first = key(r) == best[p] and p not in done
        if first:
            done.add(p)
        out.append((r.page_id, len(p.encode()), b32(p), "response" if first else "revisit", None if first or best[p][0] else best[p][1]))
    return sorted(out, key=repr)


def took(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture
def pages(spark):
    long = "longer " * 3_000_000  # beyond 16 MB: the last byte of its member is not zero
    rows = [(i, f"http://a.org/{i}", t, "x", 1) for i, t in enumerate(["a", "b", "a", None, "", "é🙂\x00\r\n\r\n", "a", "WARC/1.1\r\n\r\n", long, "\x1f\x8b"])]
    rows += [(2, "http://a.org/2", "a", "x", 1), (0, "http://b.org/other", "a", "x", 1), (0, None, "a", "x", 1), (0, "http://a.org/0", "a", "x", 1)]
    rows += [(None, "u\r\nX: y", "nobody", "x", 1), (None, None, "nobody", "x", 1), (None, None, "b", "x", 1), (-5, "neg", "b", "x", 1)]
    rows += [(100 + i, f"hot{i}", "hot payload", "x", 1) for i in range(60)] + [(100, "hot0", "hot payload", "x", 1)] * 20
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("hot,block", [(8192, 4 << 20), (4, 300)])
def test_as_brute_force(spark, pages, tmp_path, monkeypatch, hot, block):
    monkeypatch.setattr(w, "HOT_GROUPS", hot)
    monkeypatch.setattr(w, "BLOCK_BYTES", block)
    monkeypatch.setattr(w, "STEP", 1000 if block < 1000 else 1 << 16)
    w.write_archives(pages, f"{tmp_path}/a")
    got = w.read_archives(spark, f"{tmp_path}/a").cache()
    assert got.filter("error IS NOT NULL").count() == 0
    records = got.filter("record_type IN ('response', 'revisit')")
    assert took(records) == brute(pages.collect())
    # exact round trip, and each revisit refers to the one response with its payload
    want = sorted({(r.html or "").encode() for r in pages.collect()})
    assert sorted(bytes(r.payload) for r in records.filter("record_type = 'response'").collect()) == want
    ids = {r.record_id: r.payload_digest for r in records.filter("record_type = 'response'").collect()}
    assert all(ids[r.refers_to_id] == r.payload_digest for r in records.filter("record_type = 'revisit'").collect())
    assert records.select("record_id").distinct().count() == records.count()
    # plain gzip reads the files: nothing stands between the members
    for f in glob.glob(f"{tmp_path}/a/part-*"):
        with gzip.open(f) as g:
            assert g.read().startswith(b"WARC/1.1\r\n")
    got.unpersist()


def test_min_bytes(spark, pages, tmp_path):
    w.write_archives(pages, f"{tmp_path}/a", min_bytes=2)
    got = w.read_archives(spark, f"{tmp_path}/a", payloads=False)
    assert got.filter("payload_bytes < 2 AND record_type = 'revisit'").count() == 0
    assert got.filter("payload_bytes < 2 AND record_type = 'response'").count() == pages.filter("coalesce(octet_length(html), 0) < 2").count()
    assert got.filter(f"payload_digest = '{b32('hot payload')}' AND record_type = 'response'").count() == 1


def test_damage_is_found():
    whole = [w._record(k, f"u{k}", b"payload %d" % k, hashlib.sha1(b"payload %d" % k).hexdigest(), 9, None, True) for k in range(4)]
    wrong = w._record(9, "u", b"other", hashlib.sha1(b"payload").hexdigest(), 7, None, True)
    raw = lambda text: w.zlib.compress(text, 6, wbits=31)
    bad = bytearray(whole[1])
    bad[len(bad) // 2] ^= 255
    cases = {
        "gzip": whole[0] + bytes(bad) + whole[2],
        "digest": whole[0] + wrong + whole[2],
        "framing": whole[0] + raw(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort\r\n\r\n") + whole[2],
    }
    for error, data in cases.items():
        got = list(w.read_sequence(memoryview(data)))
        assert [r.get("error") for r in got if not r.get("error")] == [None, None]
        assert {r["error"] for r in got if r.get("error")} <= {error, "gzip", "framing"} and any(r.get("error") == error for r in got)
        assert [r["payload"] for r in got if not r.get("error")] == [b"payload 0", b"payload 2"]
    assert [r["error"] for r in w.read_sequence(memoryview(whole[0][:-3]))][0] == "gzip"
    assert list(w.read_sequence(memoryview(b""))) == []


def test_query(spark):
    at = "/root/testdata/sf0.01"
    assert took(w.query(spark, at)) == brute(spark.read.parquet(f"{at}/pages.parquet").collect())


def test_empty_table(spark, tmp_path):
    w.write_archives(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert w.read_archives(spark, f"{tmp_path}/a").count() == 0


def test_same_as_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{at}/pages.parquet'")
    got = w.query(spark, at)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({w.SQL})").fetchall()
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
