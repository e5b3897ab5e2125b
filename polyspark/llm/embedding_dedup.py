"""Embedding near-duplicates by sorted projection passes, and by exact comparison of what they connect.

Equal vectors of one label are a class from the start. In labels of every size each vector gets in each pass a key of concatenated random
hashes (signs of random projections about the label's mean); vectors of a label are sorted by it and each is compared with the
``WINDOW`` that follow. Pairs with enough cosine, in double precision, are links; links of all passes are united.
The number of passes follows the size of the label and what its vectors have in common, so that a pair just at the threshold is found with
``TARGET`` probability, up to ``MAX_PASSES``; closer pairs are found more often. In a dense group the hashes are not even and windows
overflow, so every component of those links is then compared whole: inside it no link is missed.
Of whole comparisons only link counts and spanning stars are passed on, never all pairs.

Cases: vectors with a null label, null, empty or zero vectors and those with null or non-finite components link with
nothing and are kept. Vectors of different lengths are not compared. Copies count as links of each other
without being expanded. A null vec_id is in no link count. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm.common import connected_components, materialize, partitions_for

MIN_COSINE = 0.93
WINDOW = 64
TARGET = 0.9999
MIN_PASSES, MAX_PASSES = 8, 256
BLOCK = 4096
#: Labels of up to so many classes are compared whole instead, by pairs of blocks: none, so the way to a link does not depend on a label's size.
EXACT_LABEL = 0
EXACT_BLOCK = 1024
SEED = 5
ROWS_PER_TASK = 500_000


def _planes(dim: int, k: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, k]).standard_normal((dim, 63))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of the unit vectors of each label and length."""
    for b in batches:
        label, size = b.column("label").to_numpy(), np.array([len(v) for v in b.column("v")], np.int64)
        out = []
        for lab, dim in np.unique(np.column_stack([label, size]), axis=0) if len(label) else ():
            at = np.flatnonzero((label == lab) & (size == dim))
            x = np.array(b.column("v").take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
            out.append((int(lab), int(dim), len(at), (x / np.linalg.norm(x, axis=1, keepdims=True)).sum(axis=0)))
        lab, dim, n, total = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lab, pa.int64()), pa.array(dim, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.list_(pa.float64()))], ["label", "dim", "n", "total"])


def directions(vectors: DataFrame, window: int = WINDOW, min_cosine: float = MIN_COSINE, target: float = TARGET) -> DataFrame:
    """``label, dim, n, mean, passes``: the mean unit vector of each label, and the passes that a pair at the threshold needs about it.

    With the mean taken off, vectors of a label lie evenly about the origin, as the hashes suppose; of a pair's cosine the share that all
    vectors of the label have is then gone, so what is left of the threshold sets the number of passes.
    """
    sums = vectors.select("label", "v").mapInArrow(_sums, "label long, dim int, n long, total array<double>")
    each = sums.select("label", "dim", "n", F.posexplode("total").alias("at", "x")).groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("m")))), lambda r: r["m"])
    rows = each.groupBy("label", "dim").agg(F.max("n").alias("n"), mean.alias("mean"))
    shared = F.aggregate("mean", F.lit(0.0), lambda s, m: s + m * m)
    left = F.when(shared < min_cosine, (min_cosine - shared) / (1 - shared)).otherwise(0.0)
    same = 1 - F.acos(left) / pi
    once = F.pow(same, F.greatest(F.lit(0.0), F.log2(F.col("n") / window)))
    need = F.ceil(F.lit(log(1 - target)) / F.log(1 - F.least(once, F.lit(1 - 1e-12)))).cast("int")
    passes = F.least(F.lit(MAX_PASSES), F.greatest(F.lit(MIN_PASSES), need))
    return materialize(rows.withColumn("passes", passes), "embedding-directions")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pass of a vector: 63 signs packed in order, so that sorting by number is sorting by the concatenated hashes."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    powers = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
    for b in batches:
        rep, label, dims, passes = (b.column(n).to_numpy() for n in ("rep", "label", "dim", "passes"))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            x, mean = (np.array(b.column(c).take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim) for c in ("v", "mean"))
            x = x / np.linalg.norm(x, axis=1, keepdims=True) - mean
            for k in range(int(passes[at].max())):
                if (dim, k) not in planes:
                    planes[dim, k] = _planes(dim, k)
                on = passes[at] > k
                key = (x[on] @ planes[dim, k] > 0) @ powers
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), k, np.int32)), pa.array(label[at][on]), pa.array(np.full(len(key), dim, np.int32)), pa.array(key), pa.array(rep[at][on])], ["k", "label", "dim", "key", "rep"]
                )


def _compare(window: int, min_cosine: float):
    """Groups are runs of one block in order; links only within a pass, label and length."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        rep, k, label, dim = (rows.column(n).to_numpy() for n in ("rep", "k", "label", "dim"))
        vec = rows.column("v").combine_chunks()
        out_a, out_b = [], []
        for d in np.unique(dim):
            at = np.flatnonzero(dim == d)
            x = np.array(vec.take(pa.array(at)).flatten(), np.float64).reshape(len(at), d)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for off in range(1, min(window, len(at) - 1) + 1):
                i, j = at[:-off], at[off:]
                ok = (np.einsum("ij,ij->i", x[:-off], x[off:]) >= min_cosine) & (k[i] == k[j]) & (label[i] == label[j])
                out_a.append(np.minimum(rep[i[ok]], rep[j[ok]]))
                out_b.append(np.maximum(rep[i[ok]], rep[j[ok]]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_a, out_b))
        pairs = np.unique(np.column_stack([a, b]), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            blocks = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)] if len(blocks) else [0]
            for s, e in zip(cuts, cuts[1:]):
                if blocks[s] != last and held:
                    yield block(pa.Table.from_batches(held))
                    held = []
                last = blocks[s]
                held.append(b.slice(s, e - s))
        if held:
            yield block(pa.Table.from_batches(held))

    return run


def links(vectors: DataFrame, window: int = WINDOW, min_cosine: float = MIN_COSINE, target: float = TARGET) -> DataFrame:
    """Distinct ``a, b`` (a < b) of ``rep``s with enough cosine. ``vectors``: ``rep, label, v``, usable ones only."""
    spark = vectors.sparkSession
    about = directions(vectors, window, min_cosine, target)
    n = about.agg(F.sum(F.col("n") * F.col("passes"))).first()[0] or 0
    tasks = partitions_for(n, ROWS_PER_TASK, spark)
    keys = vectors.withColumn("dim", F.size("v")).join(about.drop("n"), ["label", "dim"]).select("rep", "label", "dim", "v", "mean", "passes")
    keys = keys.mapInArrow(_keys, "k int, label long, dim int, key long, rep long")
    order = ["k", "label", "dim", "key", "rep"]
    keys = keys.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # the place in the whole order: that of the partition (few, one row each) and that in the partition
    keys = keys.select("*", F.spark_partition_id().alias("pid"), F.expr("monotonically_increasing_id() & 8589934591").alias("pos"))
    keys = materialize(keys, "embedding-order")
    sizes, offset, start = sorted((r.pid, r["count"]) for r in keys.groupBy("pid").count().collect()), {}, 0
    for pid, size in sizes:
        offset[pid], start = start, start + size
    offsets = spark.createDataFrame(list(offset.items()) or [(0, 0)], "pid int, start long")
    at = F.col("start") + F.col("pos")
    keys = keys.join(offsets, "pid").select("k", "label", "dim", "rep", at.alias("at"))
    # a block also gets the first rows of the next one, as far as the window reaches
    own = F.expr(f"at DIV {BLOCK}")
    blocks = F.when((F.col("at") % BLOCK < window) & (F.col("at") >= BLOCK), F.array(own, own - 1)).otherwise(F.array(own))
    keys = keys.withColumn("block", F.explode(blocks)).join(vectors.select("rep", "v"), "rep")
    keys = keys.repartition(tasks, "block").sortWithinPartitions("block", "at")
    return keys.mapInArrow(_compare(window, min_cosine), "a long, b long").distinct()


def _stars(hit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and columns of each component of ``hit`` that has a link."""
    left = hit.any(axis=1)
    while left.any():
        rows, cols = np.zeros(len(hit), bool), np.zeros(hit.shape[1], bool)
        new = np.zeros(len(hit), bool)
        new[left.argmax()] = True
        while new.any():
            rows |= new
            more = hit[new].any(axis=0) & ~cols
            cols |= more
            new = hit[:, more].any(axis=1) & ~rows
        left &= ~rows
        yield np.flatnonzero(rows), np.flatnonzero(cols)


def _compare_whole(min_cosine: float):
    """``kind, a, b`` for each pair of blocks: of kind 0 a ``rep`` and its links, of kind 1 stars over what is linked."""
    lead = ["s", "g", "dim", "i", "j"]

    def cell(rows: pa.Table) -> pa.RecordBatch:
        side, rep, copies = (rows.column(n).to_numpy() for n in ("side", "rep", "copies"))
        x = np.array(rows.column("v").combine_chunks().flatten(), np.float64).reshape(len(rep), -1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        same = rows.column("i")[0] == rows.column("j")[0]
        a = np.arange(len(rep)) if same else np.flatnonzero(side == 0)
        b = a if same else np.flatnonzero(side == 1)
        hit = x[a] @ x[b].T >= min_cosine
        if same:
            hit = np.triu(hit, 1)
            hit |= hit.T
        out = [(0, rep[a], (hit @ copies[b].astype(np.float64)).astype(np.int64))]
        if not same:
            out.append((0, rep[b], (copies[a].astype(np.float64) @ hit).astype(np.int64)))
        out = [(k, r[n > 0], n[n > 0]) for k, r, n in out]
        if rows.column("s")[0].as_py() == 0:
            for r, c in _stars(hit):
                ids = np.unique(np.concatenate([rep[a[r]], rep[b[c]]]))
                out.append((1, np.full(len(ids) - 1, ids[0]), ids[1:]))
        cols = np.concatenate([np.full(len(r), k, np.int32) for k, r, _ in out]), *(np.concatenate([o[c] for o in out]) for c in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys = np.column_stack([b.column(n).to_numpy().astype(np.int64) for n in lead])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)] if len(keys) else [0]
            for s, e in zip(cuts, cuts[1:]):
                now = tuple(keys[s])
                if now != last and held:
                    yield cell(pa.Table.from_batches(held))
                    held = []
                last = now
                held.append(b.slice(s, e - s))
        if held:
            yield cell(pa.Table.from_batches(held))

    return run


def whole(members: DataFrame, min_cosine: float) -> DataFrame:
    """Exact comparison inside each group (``s, g, dim``) of ``members``, which also have ``rep, copies, v``."""
    spark, group = members.sparkSession, ["s", "g", "dim"]
    sizes = materialize(members.groupBy(*group).agg(F.ceil(F.count("*") / EXACT_BLOCK).cast("int").alias("blocks")), "embedding-groups")
    n = sizes.agg(F.sum(F.expr(f"CAST(blocks AS LONG) * blocks * {EXACT_BLOCK}"))).first()[0] or 0
    cells = members.join(sizes, group).withColumn("own", F.expr("CAST(pmod(xxhash64(rep), blocks) AS INT)"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "copies", "v")
    order = [*group, "i", "j"]
    cells = cells.repartition(partitions_for(n, 16 * EXACT_BLOCK, spark), *order).sortWithinPartitions(*order)
    return materialize(cells.mapInArrow(_compare_whole(min_cosine), "kind int, a long, b long"), "embedding-whole")


def near_duplicates(vectors: DataFrame, window: int = WINDOW, min_cosine: float = MIN_COSINE, target: float = TARGET) -> DataFrame:
    """``vectors``: ``vec_id, embedding, label``. Returns ``vec_id, n_links, component_id, kept`` for every row."""
    ok = (
        F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.select("vec_id", "label", "v", F.coalesce(ok, F.lit(False)).alias("ok"))
    # classes of equal vectors, keyed by a digest of label and components
    digest = F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x + 0.0).cast("string"))), 256))
    rows = materialize(rows.select("vec_id", "label", F.when(F.col("ok"), F.col("v")).alias("v"), digest.alias("class")), "embedding-rows")
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.min("vec_id").alias("rep"), F.count("vec_id").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    classes = materialize(classes.filter("rep IS NOT NULL"), "embedding-classes")
    sized = classes.join(materialize(classes.groupBy("label").count(), "embedding-labels"), "label").withColumn("dim", F.size("v"))
    edges = counts = None
    if EXACT_LABEL:
        small = whole(sized.filter(F.col("count") <= EXACT_LABEL).select(F.lit(0).alias("s"), F.col("label").alias("g"), "dim", "rep", "copies", "v"), min_cosine)
        edges, counts = small.filter("kind = 1").select("a", "b"), small.filter("kind = 0")
    large = sized.filter(F.col("count") > EXACT_LABEL)
    # windows overflow in dense groups: what the passes connect is compared whole
    found = materialize(links(large.select("rep", "label", "v"), window, min_cosine, target), "embedding-links")
    comp = materialize(connected_components(found).select(F.col("id").alias("rep"), F.col("component").alias("g")), "embedding-found")
    within = whole(large.join(comp, "rep").select(F.lit(1).alias("s"), "g", "dim", "rep", "copies", "v"), min_cosine).filter("kind = 0")
    edges, counts = (found, within) if edges is None else (edges.unionByName(found), counts.unionByName(within))
    linked = counts.groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    comp = connected_components(edges).withColumnsRenamed({"id": "rep", "component": "comp"})
    classes = classes.select("class", "rep", "copies").join(linked, "rep", "left").join(comp, "rep", "left")
    classes = classes.select("class", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("vec_id", "class").join(classes, "class", "left")
    out = out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
