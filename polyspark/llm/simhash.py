"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints are one class from the start. The 64 bits are cut into partitions of correlated bits; each
partition gets a threshold of its own, the thresholds summing to ``max_distance - partitions + 1``, so that two
fingerprints within ``max_distance`` differ by no more than the threshold in at least one partition. Dynamic
programming picks the thresholds with the least estimated candidates and probes. A fingerprint is put under its
own key in each partition and probes the larger keys within the threshold; fingerprints that meet under a key
are compared in blocks, and only a spanning forest of the links found is passed on, never all pairs. A key with
more than ``BLOCK`` fingerprints is compared by pairs of blocks in separate tasks.

Cases: null and empty texts have fingerprint zero and link like any other. Texts shorter than a shingle are one
shingle. Repeated rows and repeated texts share a fingerprint; an id that two rows share links nothing. A document without
an id gets a fingerprint, links others and gets the smallest id of its component (null where no document in it has one). An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm.common import connected_components, materialize, partitions_for
from polyspark.llm.sentencepiece_codec import slices

BITS = 64
SEED = 42
BLOCK = 8192
#: Rows compared at once.
STRIP = 1024
#: What one probe costs, in comparisons.
PROBE_COST = 30
ROWS_PER_TASK = 2_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, A-Z lower-cased, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < words:
        return np.array([h(join(w), SEED)], np.uint64)
    return np.fromiter((h(join(x), SEED) for x in zip(*(w[k:] for k in range(words)))), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half the hashes have it; as a signed 64-bit number."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start : start + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                fp = [fingerprint(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _unpack(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp.astype(np.int64)).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)


def bit_correlations(classes: DataFrame) -> np.ndarray:
    """Correlation of each pair of bits over all distinct fingerprints (64 x 64, summed on the executors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((BITS + 1, BITS + 1))
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), _unpack(b.column("fp").to_numpy())]).astype(np.float32)
            gram += x.T @ x
        flat = gram.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "s"])

    sums = classes.select("fp").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow().to_pandas()
    gram = np.zeros((BITS + 1) ** 2)
    gram[sums["at"].to_numpy()] = sums["s"].to_numpy()
    gram = gram.reshape(BITS + 1, BITS + 1)
    n = max(gram[0, 0], 1.0)
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    return cov / np.outer(sd, sd)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Cuts the bits into ``parts`` groups of about equal size, each grown by the bit most correlated with it."""
    left, strength, out = set(range(BITS)), np.abs(corr), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (strength[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: (strength[b, group].sum(), -b))
            group.append(nxt)
            left.discard(nxt)
        out.append(sorted(group))
    return out


def _ball(bits: int, radius: int) -> int:
    return sum(comb(bits, r) for r in range(radius + 1)) if radius >= 0 else 0


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds (-1: not probed) that sum to ``total`` at the least cost; ``costs[p][t + 1]`` is that of ``t`` in ``p``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (v, ts) in best.items():
            for t in range(-1, len(c) - 1):
                if s + t not in new or v + c[t + 1] < new[s + t][0]:
                    new[s + t] = (v + c[t + 1], [*ts, t])
        best = new
    return best[total][1]


def _cost(n: int, bits: int, radius: int, same: float) -> float:
    """Comparisons and probes of a partition: ``same`` pairs under equal keys, the others as evenly as their keys."""
    if radius < 0:
        return 0.0
    keys = min(2.0**bits, n * n / max(2 * same + n, 1.0))
    return same + n * n / 2 * (_ball(bits, radius) - 1) / max(keys, 1.0) + PROBE_COST * n * (_ball(bits, radius) + 1) / 2


def plan(classes: DataFrame, n: int, max_distance: int) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of every partition that is probed."""

    def even(parts: int) -> float:
        bits, left = BITS // parts, max_distance - parts + 1
        low = left // parts
        return sum(_cost(n, bits, low + (k < left - low * parts), n * n / 2 / 2.0**bits) for k in range(parts))

    # enough partitions for thresholds of up to four bits
    parts = min(range(max(2, -(-(max_distance + 1) // 5)), min(8, max_distance + 1) + 1) if max_distance else [1], key=even)
    groups = group_bits(bit_correlations(classes), parts)
    keys = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), _key(g).alias("key")) for p, g in enumerate(groups)])).alias("k")
    same = classes.select(keys).groupBy("k.p", "k.key").count().groupBy("p").agg(F.sum(F.expr("count * (count - 1) / 2D")).alias("s"))
    same_of = {r.p: r.s for r in same.collect()}
    most = min(max_distance, 4)
    costs = [[_cost(n, len(g), t, same_of.get(p, 0.0)) for t in range(-1, most + 1)] for p, g in enumerate(groups)]
    return [(g, t) for g, t in zip(groups, allocate(costs, max_distance - parts + 1)) if t >= 0]


def _key(bits: list[int]):
    """The bits of a group, in place: the fingerprint under the group's mask."""
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)))


def _mask(bits: list[int]) -> int:
    m = sum(1 << (BITS - 1 - b) for b in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def _probe(parts: list[tuple[list[int], int]]):
    masks = [np.int64(_mask(bits)) for bits, _ in parts]
    flips = [np.array([_mask(list(c)) for r in range(t + 1) for c in combinations(bits, r)], np.int64) for bits, t in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                fp = whole.column("fp").to_numpy()[start : start + 4096]
                for p, (mask, flip) in enumerate(zip(masks, flips)):
                    own = fp & mask
                    keys = own[:, None] ^ flip[None, :]
                    # of two fingerprints with different keys, the one with the smaller key probes
                    at, _ = np.nonzero(keys >= own[:, None])
                    keys = keys[keys >= own[:, None]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), p, np.int32)), pa.array(keys), pa.array(fp[at])], ["p", "key", "fp"])

    return run


def _forest(fp: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all that links within ``most`` bits connect: each fingerprint is compared as it is reached."""
    fp = np.unique(fp)
    left = fp
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            strip, front = front[:STRIP], front[STRIP:]
            near = np.full(len(left), BITS + 1, np.uint8)
            who = np.zeros(len(left), np.int64)
            step = max(1, 4_000_000 // len(left))
            for k in range(0, len(strip), step):
                part = strip[k : k + step]
                d = np.bitwise_count(part[:, None] ^ left[None, :])
                j = d.argmin(axis=0)
                v = d[j, np.arange(len(left))]
                who, near = np.where(v < near, part[j], who), np.minimum(v, near)
            hit = near <= most
            if hit.any():
                yield who[hit], left[hit]
                front = np.concatenate([front, left[hit]])
                left = left[~hit]


def _link(most: int):
    """Runs of rows with equal leading columns are one group; the last column is the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []

        def close() -> None:
            if held:
                group = np.concatenate(held)
                held.clear()
                if len(group) > 1:
                    for a, b in _forest(group, most):
                        out_a.append(a)
                        out_b.append(b)

        def flush() -> pa.RecordBatch:
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
            out_a.clear()
            out_b.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["fp_a", "fp_b"])

        for b in batches:
            cols = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
            if not len(cols):
                continue
            cuts = [0, *(np.flatnonzero((cols[1:, :-1] != cols[:-1, :-1]).any(axis=1)) + 1), len(cols)]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(cols[s, :-1])
                if key != last:
                    close()
                    last = key
                held.append(cols[s:e, -1])
            if len(out_a) > 10_000:
                yield flush()
        close()
        yield flush()

    return run


def links(classes: DataFrame, max_distance: int, block: int = BLOCK) -> DataFrame:
    """``fp_a, fp_b``: links within ``max_distance`` that connect all that such links connect. ``classes``: distinct ``fp``."""
    spark, n = classes.sparkSession, classes.count()
    parts = plan(classes, n, max_distance)
    rows = sum((_ball(len(bits), t) + 1) // 2 for bits, t in parts) * n
    probes = classes.select("fp").mapInArrow(_probe(parts), "p int, key long, fp long")
    # keys that more fingerprints share than a task should compare at once
    hot = probes.groupBy("p", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    hot = materialize(hot.select("p", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "simhash-hot")
    if hot.isEmpty():
        probes = probes.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        own = F.expr("pmod(xxhash64(fp), blocks)").cast("int")
        probes = probes.join(hot, ["p", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
        probes = probes.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        probes = probes.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    tasks = partitions_for(rows, ROWS_PER_TASK, spark)
    probes = probes.select("p", "key", "i", "j", "fp").repartition(tasks, "p", "key", "i", "j").sortWithinPartitions("p", "key", "i", "j")
    return probes.mapInArrow(_link(max_distance), "fp_a long, fp_b long")


def near_duplicates(docs: DataFrame, words: int = 3, max_distance: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row. Fingerprints are the nodes, so links lead through documents without an id as well."""
    prints = materialize(fingerprints(docs, words), "simhash-docs")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    found = links(classes, max_distance).distinct()
    comp = connected_components(found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))).withColumnRenamed("id", "fp")
    linked = materialize(classes.join(comp, "fp"), "simhash-linked")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(smallest, "component").select("fp", "component_id", F.lit(True).alias("found"))
    classes = classes.join(linked, "fp", "left").select("fp", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
