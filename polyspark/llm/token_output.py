"""Token-ID output in training order: a keyed Feistel permutation gives every sequence a global slot.

Documents are put in order by range, then coded and cut into sequences of ``seq_len`` ids (the last one padded). Sequences are numbered
without gaps in the order of a hash of the document's id, then id and text hash, however the table is partitioned; the
Feistel network over the next even number of bits, walked along its cycle until the value is below the count, permutes the
numbers. Slots are dealt by range to shards of ``per_shard`` sequences, and ``write_shards`` writes each as a raw file of
fixed stride: slot ``s`` is at byte ``(s % per_shard) * stride`` of shard ``s // per_shard``, so readers seek and go on
from any slot, in sequence.

Cases: a null or empty text has no sequence and takes no slot. Repeated rows are separate documents; rows of equal id and
text are next to each other before the permutation. A very long text makes many sequences and is coded by itself. An empty
table gives no slot and no shard. Of the input only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyspark.llm.common import materialize, partitions_for
from polyspark.llm.sentencepiece_codec import MODEL, codec_of, shared_vocabulary, slices

SEQ_LEN = 512
PER_SHARD = 2048
PAD = 0
KEY = 20240607
ROUNDS = 6
#: Documents that a task puts in order and codes, about.
ROWS_PER_BUCKET = 4096
BYTES_PER_TASK = 64 << 20
#: Bytes of texts that are coded together, about: a part that comes again among them is segmented once.
BYTES_AT_ONCE = 8_000_000


@dataclass(frozen=True)
class Layout:
    seq_len: int = SEQ_LEN
    per_shard: int = PER_SHARD
    pad: int = PAD
    key: int = KEY

    @property
    def stride(self) -> int:
        """Bytes from one sequence to the next: its ids and one line feed, which Spark's text writer puts behind every record."""
        return self.seq_len * 2 + 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as the round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, count: int, key: int = KEY) -> np.ndarray:
    """The slot of each number in ``range(count)``: a bijection, the same for the same key and count."""
    half = np.uint64(max(1, (max(1, count - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key * ROUNDS + r) & mask)
        out[todo] = x = (left << half) | right
        todo = todo[x >= np.uint64(count)]
    return out.astype(np.int64)


def _code(shared, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, before = codec_of(shared), 0
        for whole in batches:
            for b in slices(whole, "text", BYTES_AT_ONCE):
                ids = codec.encode_column(b.column("text"))
                n_seq = -(-pc.binary_length(ids).to_numpy().astype(np.int64) // (2 * layout.seq_len))
                inside = before + np.cumsum(n_seq) - n_seq
                before += int(n_seq.sum())
                keep = pa.array(np.flatnonzero(n_seq))
                columns = [b.column("doc_id").take(keep), pa.array(inside).take(keep), pa.array(n_seq).take(keep), ids.take(keep)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "inside", "n_seq", "ids"])

    return run


def _place(count: int, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "ids", 4_000_000):
                first, n_seq = (b.column(n).to_numpy() for n in ("first", "n_seq"))
                which = np.repeat(np.arange(len(first)), n_seq)
                seq = np.arange(len(which)) - np.repeat(np.cumsum(n_seq) - n_seq, n_seq)
                slot = permute(first[which] + seq, count, layout.key)
                size, raw = 2 * layout.seq_len, b.column("ids").to_pylist()
                payload = [raw[w][s * size : (s + 1) * size] for w, s in zip(which.tolist(), seq.tolist())]
                tokens = np.array([len(x) // 2 for x in payload], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), b.column("doc_id").take(pa.array(which)), pa.array(seq.astype(np.int32)), pa.array(tokens), pa.array(payload, pa.binary())],
                    ["slot", "doc_id", "seq_no", "n_tokens", "payload"],
                )

    return run


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` by range of the unsigned hash of the id, the id and the text's hash, sorted within partitions.

    Equal rows, however many, are told apart by a running number, so no group of them is one task's.
    """
    doc_id, spark = F.col("doc_id").cast("long"), docs.sparkSession
    tasks = partitions_for(docs.count(), ROWS_PER_BUCKET, spark)
    place = F.xxhash64(doc_id, doc_id.isNull()).bitwiseXOR(F.lit(-(1 << 63)))
    rows = docs.filter("text <> ''").select(doc_id.alias("doc_id"), "text", place.alias("place"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64("text").alias("th"))
    order = ["place", "id", "th", "nth"]
    rows = rows.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return rows.select("doc_id", "text")


def numbered(coded: DataFrame) -> tuple[DataFrame, int]:
    """``coded`` with ``first`` (the number of a document's first sequence), and the count of all sequences.

    Rows have ``inside``, the sequences before them in their partition ``part``; one number for each partition is broadcast.
    """
    parts = coded.groupBy("part").agg(F.sum("n_seq").alias("size"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select("part", "size", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("start")), "token-parts")
    rows = coded.join(F.broadcast(parts.select("part", "start")), "part")
    return rows.withColumn("first", F.col("start") + F.col("inside")), parts.agg(F.sum("size")).first()[0] or 0


def training_order(docs: DataFrame, layout: Layout | None = None, model: str = MODEL) -> DataFrame:
    """Returns ``slot, shard, byte_offset, doc_id, seq_no, n_tokens, payload`` for every sequence.

    A partition holds a range of whole shards, in slot order; partitions go by shard as well.
    """
    layout, spark = layout or Layout(), docs.sparkSession
    shared = shared_vocabulary(spark, model)
    if len(shared.value.pieces) > 1 << 16:
        raise ValueError("ids need more than two bytes")
    coded = in_order(docs).mapInArrow(_code(shared, layout), "doc_id long, inside long, n_seq long, ids binary")
    rows, count = numbered(materialize(coded.withColumn("part", F.spark_partition_id()), "token-ids"))
    rows = rows.select("doc_id", "n_seq", "ids", "first")
    rows = rows.mapInArrow(_place(count, layout), "slot long, doc_id long, seq_no int, n_tokens int, payload binary")
    shards = max(1, -(-count // layout.per_shard))
    tasks = min(shards, partitions_for(count * layout.stride, BYTES_PER_TASK, spark))
    rows = rows.withColumns({"shard": F.expr(f"CAST(slot DIV {layout.per_shard} AS INT)"), "byte_offset": F.expr(f"slot % {layout.per_shard} * {layout.stride}")})
    # slots are a permutation of range(count), so ranges of shards are even without a sample
    rows = rows.repartitionById(tasks, F.expr(f"CAST(CAST(shard AS BIGINT) * {tasks} DIV {shards} AS INT)")).sortWithinPartitions("shard", "slot")
    whole = F.rpad("payload", F.lit(2 * layout.seq_len), F.lit(layout.pad.to_bytes(2, "little")))
    return rows.select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", whole.alias("payload"))


def write_shards(ordered: DataFrame, path: str) -> None:
    """One raw file in the folder ``shard=N`` for each shard: a record of ``stride`` bytes for each slot, in order.

    Spark's own committed write: what lost or repeated tasks left behind is never seen.
    """
    ordered.select(F.col("payload").cast("string").alias("value"), "shard").write.mode("overwrite").option("lineSep", "\n").partitionBy("shard").text(path)


def read_slots(spark: SparkSession, path: str, start: int, stop: int, layout: Layout | None = None) -> DataFrame:
    """``slot, payload`` of slots ``start`` up to ``stop``, in order: only the files of their shards are read, each cut by the stride."""
    layout = layout or Layout()
    shards = F.col("shard").between(start // layout.per_shard, (stop - 1) // layout.per_shard)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).filter(shards)
    rows = files.select("shard", "content", F.explode(F.sequence(F.lit(0), F.expr(f"CAST(length DIV {layout.stride} AS INT) - 1"))).alias("at"))
    payload = F.substring("content", F.col("at") * layout.stride + 1, F.lit(2 * layout.seq_len))
    rows = rows.select((F.col("shard").cast("long") * layout.per_shard + F.col("at")).alias("slot"), payload.alias("payload"))
    return rows.filter(F.col("slot").between(start, stop - 1)).orderBy("slot")


def query(spark, sf_dir: str) -> DataFrame:
    return training_order(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
