import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from polyspark.llm import sentencepiece_codec as sp
from polyspark.llm import token_output as t


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        slots = t.permute(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
        assert (slots == np.concatenate([t.permute(np.arange(n)[:3], n), t.permute(np.arange(n)[3:], n)])).all()
    assert (t.permute(np.arange(1000), 1000, 1) != t.permute(np.arange(1000), 1000, 2)).any()


def test_round_trip_and_resume(spark, docs, tmp_path):
    layout = t.Layout(seq_len=32, per_shard=16)
    ordered = t.training_order(docs, layout)
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(len(r.payload) == 2 * layout.seq_len and r.shard == r.slot // 16 and r.byte_offset == r.slot % 16 * layout.stride for r in rows)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.seq_no, np.frombuffer(r.payload, "<u2")[: r.n_tokens].tolist()))
    once = docs.groupBy("doc_id").count().filter("count = 1 AND doc_id IS NOT NULL").select("doc_id")
    for r in sp.encode(docs.select("doc_id", "text").join(once, "doc_id")).collect():
        assert sum((x for _, x in sorted(got.get(r.doc_id, []))), []) == (r.ids or [])
    t.write_shards(ordered, f"{tmp_path}/shards")
    part = [(r.slot, bytes(r.payload)) for r in t.read_slots(spark, f"{tmp_path}/shards", 10, 40, layout).collect()]
    want = {r.slot: bytes(r.payload) for r in rows}
    assert part == [(s, want[s]) for s in range(10, min(40, len(rows)))]
    # a reader seeks to the place of any slot and goes on from there, also in the middle of a shard
    for r in rows:
        (file,) = glob.glob(f"{tmp_path}/shards/shard={r.shard}/part-*")
        with open(file, "rb") as f:
            f.seek(r.byte_offset)
            assert f.read(layout.stride) == bytes(r.payload) + b"\n"
    assert sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/shards/shard=*/part-*")) == len(rows) * layout.stride


def test_partitions_do_not_matter(spark, docs, monkeypatch):
    layout = t.Layout(seq_len=16, per_shard=8)
    take = lambda df: sorted((r.slot, r.doc_id if r.doc_id is not None else -1, r.seq_no, bytes(r.payload)) for r in t.training_order(df, layout).collect())
    docs = docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text").filter("doc_id < 20"))
    one = take(docs.repartition(2))
    monkeypatch.setattr(t, "ROWS_PER_BUCKET", 2)
    assert take(docs.repartition(5)) == one
    # plain Python: documents in order, sequences numbered, slots by the permutation
    key = docs.filter("text <> ''").select("doc_id", "text", F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("p"), F.xxhash64("text").alias("h")).collect()
    codec, number = sp.Codec(sp.load_vocabulary()), []
    for r in sorted(key, key=lambda r: (r.p % 2**64, r.doc_id or 0, r.h)):
        ids = codec.encode(r.text)
        number += [(r.doc_id if r.doc_id is not None else -1, k, ids[s : s + 16] + [0] * (16 - len(ids[s : s + 16]))) for k, s in enumerate(range(0, len(ids), 16))]
    slots = t.permute(np.arange(len(number)), len(number))
    assert one == sorted((int(s), d, k, np.array(x, "<u2").tobytes()) for s, (d, k, x) in zip(slots, number))


def test_empty_table(none):
    assert t.training_order(none).count() == 0


def test_no_ids_cross_the_shuffle_before_their_slot(spark, docs, monkeypatch):
    """Texts are put in order before they are coded, so numbers come by offsets of partitions; many equal rows are many tasks' work."""
    monkeypatch.setattr(t, "ROWS_PER_BUCKET", 10)
    copies = spark.range(200).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same words again' AS text")
    rows = t.in_order(copies)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 and max(sizes) < 100
    plan = t.training_order(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange rangepartitioning") == 0
    assert sorted(r.slot for r in t.training_order(copies).collect()) == list(range(200))


def test_columns_are_coded_side_by_side(spark, texts, monkeypatch):
    """The bytes are those of text by text, but parts whose characters all have pieces are not segmented one by one."""
    layout, many = t.Layout(seq_len=64), [" ".join(f"{a}w{b}," for b in "abcdefgh") for a in "ijklmnopqrst"]
    awkward = ["  two  runs   of spaces  ", " ", "   ", "\n", "\n\n a\n b \n", "mark ▁ and ▁▁", "▁", "x" * 200 + " y" * 3, "\x00 \ufffd \x7f", "日本語 のテキスト", "tab\tand 🙂", "ends in a line\n"]
    all_texts, codec = [*texts, *awkward, *many], sp.Codec(sp.load_vocabulary())
    want = [codec.encode_bytes(x) if x else b"" for x in all_texts]
    assert want == [np.array(codec.encode(x or ""), "<u2").tobytes() for x in all_texts]
    for some in (slice(None), slice(3, 40), slice(0, 2), slice(5, 6), slice(0, 0)):
        column = pa.array(["other", *all_texts])[1:][some]
        monkeypatch.setattr(sp, "PARTS_AT_ONCE", 7 if some.start else 1 << 14)
        assert codec.encode_column(column).to_pylist() == want[some]
    alone = []
    monkeypatch.setattr(sp.Codec, "viterbi", lambda self, s: alone.append(s) or [0])
    monkeypatch.setattr(sp, "_CODECS", {})
    shared = type("Shared", (), {"value": sp.load_vocabulary()})()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(many)), pa.int64()), pa.array(many)], ["doc_id", "text"])
    (coded,) = t._code(shared, layout)(iter([batch]))
    assert coded.column("ids").to_pylist() == want[-len(many) :] and alone == []
