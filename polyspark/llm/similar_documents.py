"""Near-duplicate documents: the SimHash links of ``simhash``, and what they miss by an exact prefix filter and exact Jaccard.

Documents are linked where their fingerprints are (``simhash.links``: ``MAX_DISTANCE`` bits or fewer), and where their sets of word shingles have
Jaccard ``MIN_SIMILARITY`` or more; groups are the components of both kinds of links together.

Documents with the same set of word shingles are one class. The shingles of a class are put in one order for all
classes, rare ones first: those that are frequent among the smallest hashes go last. Two sets of enough
Jaccard share a shingle among the first ``n - ceil(share * n) + 1`` of each, so classes that meet under such a shingle,
and whose sizes and places allow the similarity, are candidates: no pair is missed, whatever the order.
A class with up to ``FEW`` candidates under a shingle gives them as pairs. They are screened by bit sketches, the parity of
the shingles that fall on each bit: two sets differ in at least as many shingles as their sketches in bits, so a pair
whose sketches differ in more bits than its sizes allow is none, and nothing else is dropped. The others are verified by two
joins. A class with more candidates gives only the links of a spanning forest; the components of those forests are compared whole, block by block, by exact
Jaccard, and give a spanning forest of the true links: no link is lost and no group is expanded into its pairs.

Cases: null, empty and blank texts are one class, alike only to each other. Texts shorter than a shingle are one
shingle. Rows without an id rank last when the one row of a group that stays is picked; of rows with the same id and
text one stays. Shingles are not stored: each pass takes them from the texts anew, so ``docs`` should be a table, not a long plan. An empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspark.llm import simhash
from polyspark.llm.common import broadcast_value, connected_components, free_prefix, materialize, partitions_for
from polyspark.llm.sentencepiece_codec import slices

WORDS = 5
MIN_SIMILARITY = 0.8
#: Words of a fingerprint's shingles, and most bits in which linked fingerprints differ.
PRINT_WORDS = 3
MAX_DISTANCE = 3
#: Most shingles that are known as frequent (12 bytes each, broadcast), and from how many classes on.
FREQUENT = 1 << 20
FREQUENT_FROM = 3
#: Candidates of one probe under one key that are given as pairs.
FEW = 32
#: Classes under one key that a task holds.
BLOCK = 8192
#: Classes of a dense component that are compared at once.
SET_BLOCK = 256
CELL = 4_000_000
#: Shingles that a task counts at once.
CHUNK = 1 << 20
NO_ID = (1 << 63) - 1
NO_POS = (1 << 31) - 1


def _sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    return [np.unique(simhash.shingle_hashes(t, words)) for t in texts]


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([simhash.xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in arrays], pa.list_(pa.int64()))


def prints(docs: DataFrame, words: int) -> DataFrame:
    """``id, th, sd, fp``: text hash, hash of the shingle set and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                fp = [simhash.fingerprint(simhash.shingle_hashes(t, PRINT_WORDS)) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), _digests(_sets(texts, words)), pa.array(fp, pa.int64())], ["id", "th", "sd", "fp"])

    return docs.select("id", "th", "text").mapInArrow(run, "id long, th long, sd long, fp long")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """``sd, shingles``: the sorted hashes of the shingles of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = _sets(b.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([_digests(sets), _lists(sets)], ["sd", "shingles"])

    return docs.select("text").mapInArrow(run, "sd long, shingles array<long>")


_HEADS = "sd long, n int, head array<long>, sketch array<long>"


def prefix_length(n: int, share: float) -> int:
    return n - ceil(share * n - 1e-9) + 1 if n else 0


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the shingles on each of as many bits as the next power of two (64 at least): longs, halves fold into each other."""
    bits = max(64, 1 << (max(1, len(shingles)) - 1).bit_length())
    odd = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_be_similar(share: float):
    """Whether the sketches ``x`` and ``y`` of sets of ``n`` and ``m`` shingles differ in no more bits than such sets may."""
    folded = "zip_with(slice({0}, 1, size({0}) DIV 2), slice({0}, size({0}) DIV 2 + 1, size({0}) DIV 2), (u, v) -> u ^ v)"
    x = f"IF(size(x) > size(y), {folded.format('x')}, x)"
    y = f"IF(size(y) > size(x), {folded.format('y')}, y)"
    differ = f"aggregate(zip_with({x}, {y}, (u, v) -> CAST(bit_count(u ^ v) AS INT)), 0, (s, c) -> s + c)"
    # sketches of lengths too far apart to be folded once (only under a share of less than a half) decide nothing
    return F.expr(f"COALESCE({differ} <= (n + m) * CAST({(1 - share) / (1 + share)} AS DOUBLE) + 1e-6, true)")


def _first(words: int, share: float):
    """``t``: the smallest shingles of each set, as many as its prefix has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                firsts = [x[: prefix_length(len(x), share)] for x in _sets(b.column("text").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64))], ["t"])

    return run


def _prefixes(words: int, share: float, frequent):
    """``sd, n, head, sketch``: the first shingles of each set; ``frequent`` (sorted hashes and their counts) go last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = _sets(b.column("text").to_pylist(), words)
                heads = []
                for x in (y.view(np.int64) for y in sets):
                    if len(frequent.value[0]):
                        value, count = frequent.value
                        at = np.minimum(np.searchsorted(value, x), len(value) - 1)
                        x = x[np.argsort(np.where(value[at] == x, count[at], 0), kind="stable")]
                    heads.append(x[: prefix_length(len(x), share)])
                n = pa.array([len(x) for x in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([_digests(sets), n, _lists(heads), _lists([sketch(x.view(np.int64)) for x in sets])], ["sd", "n", "head", "sketch"])

    return run


def _counts(chunk: int):
    """``key, times``: shingles that come twice or more in about ``chunk`` of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            key, times = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key[times > 1]), pa.array(times[times > 1])], ["key", "times"])

        for b in batches:
            held.append(b.column("head").flatten().to_numpy())
            if sum(map(len, held)) >= chunk:
                yield counted()
        yield counted()

    return run


def hot_keys(heads: DataFrame, n: int, block: int) -> DataFrame:
    """``key, cells``: shingles that lead more classes than a task should hold, and how many cells they are dealt to.

    Only what comes twice or more in a chunk is counted over all chunks. At most half a block of a shingle's classes stand alone in their chunk as
    long as there are no more chunks than that, so none with over a block of classes is missed; a cell too many changes no result.
    """
    counts = heads.select("head").mapInArrow(_counts(max(CHUNK, n // max(1, block // 4))), "key long, times long")
    counts = counts.groupBy("key").agg(F.sum("times").alias("times")).filter(F.col("times") > block / 2)
    return materialize(counts.select("key", F.ceil((F.col("times") + block / 2) / block).cast("int").alias("cells")), "similar-hot")


def _allowed(share: float, n, pos, m, at):
    """Whether sets of ``n`` and ``m`` shingles whose first common one is at ``pos`` and ``at`` may be similar."""
    most = np.minimum(pos, at) + 1 + np.minimum(n - pos, m - at) - 1
    return (np.minimum(n, m) >= share * np.maximum(n, m) - 1e-9) & (most >= share / (1 + share) * (n + m) - 1e-9)


class _Key:
    """The classes held under a key, and the links of the probes that have come so far."""

    def __init__(self, sd: np.ndarray, n: np.ndarray, pos: np.ndarray):
        self.sd, self.n, self.pos = sd, n, pos
        self.root = np.arange(len(sd))

    def meet(self, share: float, sd, n, pos, below: bool, give) -> None:
        """Compares probes with the classes held; ``below``: they are the same, each meets those before it."""
        step = max(1, CELL // max(1, len(self.sd)))
        for s in range(0, len(sd), step):
            hit = _allowed(share, n[s : s + step, None], pos[s : s + step, None], self.n[None, :], self.pos[None, :])
            if below:
                hit &= np.arange(len(self.sd))[None, :] < np.arange(s, min(len(sd), s + step))[:, None]
            i, j = np.nonzero(hit)
            count = np.bincount(i, minlength=1)
            few = count[i] <= FEW
            give(0, sd[s + i[few]], self.sd[j[few]])
            i, j = i[~few], j[~few]
            for k, start, end in zip(*_runs(i)):
                to = j[start:end]
                roots = np.unique(self.root[to])
                give(1, np.append(sd[s + k], self.sd[roots[1:]]), np.append(self.sd[to[0]], np.full(len(roots) - 1, self.sd[roots[0]])))
                if len(roots) > 1:
                    self.root[np.isin(self.root, roots)] = roots[0]


def _runs(i: np.ndarray):
    starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    return i[starts], starts, np.append(starts[1:], len(i))


def _meet(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        give = lambda kind, a, b: out.append((np.full(len(a), kind, np.int32), np.minimum(a, b), np.maximum(a, b))) if len(a) else None
        held: list[tuple] = []
        key, owners = None, None

        def close() -> None:
            """All classes to hold under the key have come: they meet each other."""
            nonlocal owners
            if owners is None and held:
                rows = tuple(np.concatenate(c) for c in zip(*held))
                held.clear()
                owners = _Key(*rows)
                owners.meet(share, *rows, True, give)

        for b in batches:
            key_, cell, sd, at = (b.column(c).to_numpy() for c in ("key", "cell", "sd", "at"))
            cols = [key_, cell, at >> 62, sd, at >> 31 & NO_POS, at & NO_POS]
            if not len(cols[0]):
                continue
            new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            first, size = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(new)))
            # short runs inside the batch at once: nobody has more than FEW before it
            short = (size <= FEW + 1) & (np.maximum.reduceat(cols[2], first) == 0)
            short[[0, -1]] = False
            of = np.repeat(np.arange(len(first)), size)
            for off in range(1, FEW + 1):
                i = np.flatnonzero((of[:-off] == of[off:]) & short[of[:-off]]) if len(of) > off else np.zeros(0, np.int64)
                i = i[_allowed(share, cols[4][i], cols[5][i], cols[4][i + off], cols[5][i + off])]
                give(0, cols[3][i], cols[3][i + off])
            edge = np.zeros(len(first), bool)
            edge[[0, -1]] = True
            keep = (~short & ((size > 1) | edge))[of]
            cols = [c[keep] for c in cols]
            lead = np.column_stack([c.astype(np.int64) for c in cols[:3]])
            cuts = [0, *(np.flatnonzero((lead[1:] != lead[:-1]).any(axis=1)) + 1), len(lead)]
            for s, e in zip(cuts, cuts[1:]):
                now, role = tuple(lead[s, :2]), lead[s, 2]
                if now != key:
                    close()
                    key, owners = now, None
                rows = tuple(c[s:e] for c in cols[3:])
                if role == 0:
                    held.append(rows)
                    continue
                close()
                if owners is not None:
                    owners.meet(share, *rows, False, give)
            if len(out) > 500:
                yield _pairs(out)
        close()
        yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "a", "b"])


def frequent_shingles(plain: DataFrame, words: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent shingles among the smallest of each set."""
    counts = plain.select("text").mapInArrow(_first(words, share), "t long").groupBy("t").count()
    counts = materialize(counts.filter(F.col("count") >= FREQUENT_FROM), "similar-frequent")
    least, total = 1 << 62, 0
    for r in counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        total += r.n
        if total > FREQUENT:
            break
        least = r["count"]
    got = counts.filter(F.col("count") >= least).orderBy("t").toArrow()
    return got.column("t").to_numpy(), np.minimum(got.column("count").to_numpy(), (1 << 31) - 1).astype(np.int32)


def ordered_heads(plain: DataFrame, words: int, share: float) -> DataFrame:
    """``sd, n, head, sketch`` once for every class."""
    value = frequent_shingles(plain, words, share)
    shared = broadcast_value(plain.sparkSession, value, sum(v.nbytes for v in value))
    heads = plain.select("text").mapInArrow(_prefixes(words, share, shared), _HEADS).groupBy("sd")
    return materialize(heads.agg(*(F.first(c).alias(c) for c in ("n", "head", "sketch"))), "similar-heads")


def candidates(heads: DataFrame, share: float, block: int = BLOCK) -> DataFrame:
    """``kind, a, b``: of kind 0 pairs to verify, of kind 1 links of forests over the denser candidates."""
    spark = heads.sparkSession
    n = heads.agg(F.sum(F.size("head"))).first()[0] or 0
    tasks = partitions_for(n, simhash.ROWS_PER_TASK, spark)
    # size and place in one number, under a bit that probes have
    place = F.shiftleft(F.col("n").cast("long"), 31) + F.col("pos")
    rows = heads.select("sd", "n", F.posexplode("head").alias("pos", "key")).select("key", "sd", place.alias("at"))
    hot = hot_keys(heads, n, block)
    if hot.isEmpty():
        rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "at").withColumn("cell", F.lit(0))
    else:
        rows = rows.join(hot, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        rows = rows.withColumn("own", F.expr("CAST(pmod(xxhash64(sd), cells) AS INT)"))
        # a class is held in its cell and probes the cells before it
        rows = rows.withColumn("cell", F.explode(F.expr("sequence(0, own)")))
        rows = rows.select("key", "cell", "sd", (F.col("at") + F.when(F.col("cell") != F.col("own"), F.lit(1 << 62)).otherwise(0)).alias("at"))
        rows = rows.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell", "at")
    return rows.mapInArrow(_meet(share), "kind int, a long, b long").distinct()


def _jaccard_links(x: list[np.ndarray], y: list[np.ndarray], least: float) -> Iterator[np.ndarray]:
    """Row numbers ``i`` of ``x`` and ``j`` of ``y`` with enough Jaccard."""
    sets = x + y
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    value, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    which = np.repeat(np.arange(len(sets)), sizes)
    # a shingle of one set is in no intersection
    keep = times[at] > 1
    number = np.cumsum(times > 1) - 1
    at, which = number[at[keep]], which[keep]
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    common = np.zeros((len(x), len(y)), np.float32)
    wide = 8192
    for s in range(0, int(at[-1]) + 1 if len(at) else 0, wide):
        lo, hi = np.searchsorted(at, [s, s + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[which[lo:hi], at[lo:hi] - s] = 1
        common += m[: len(x)] @ m[len(x) :].T
    union = sizes[: len(x), None] + sizes[None, len(x) :] - common
    return np.nonzero(common >= least * union)


def _compare(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def close() -> pa.RecordBatch:
            left, right = ([r for r in held if r[0] == side] for side in (0, 1))
            if not right:
                right = left
            a, b = [], []
            if left and right:
                i, j = _jaccard_links([r[2] for r in left], [r[2] for r in right], least)
                root: dict[int, int] = {}

                def find(k: int) -> int:
                    while root.setdefault(k, k) != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                for u, v in zip(i.tolist(), j.tolist()):
                    u, v = left[u][1], right[v][1]
                    ru, rv = find(u), find(v)
                    if ru != rv:
                        root[ru] = rv
                        a.append(u)
                        b.append(v)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("comp", "i", "j", "side", "sd")), b.column("shingles")):
                if r[:3] != last:
                    if held:
                        yield close()
                        held = []
                    last = r[:3]
                held.append((r[3], r[4], r[5].values.to_numpy()))
        if held:
            yield close()

    return run


def print_links(rows: DataFrame, max_distance: int) -> DataFrame:
    """``a, b``: links between classes (by ``sd``) that connect all that fingerprints (``fp``) within ``max_distance`` bits connect.

    A fingerprint stands for the class with the smallest hash that has it; rows of one class may differ in theirs.
    """
    rows = materialize(rows.select("sd", "fp").distinct(), "similar-fingerprints")
    home = materialize(rows.groupBy("fp").agg(F.min("sd").alias("home")), "similar-homes")
    found = simhash.links(home.select("fp"), max_distance).distinct()
    ends = (home.select(F.col("fp").alias(f"fp_{c}"), F.col("home").alias(c)) for c in "ab")
    for end in ends:
        found = found.join(end, [c for c in end.columns if c.startswith("fp_")])
    own = rows.join(home, "fp").select(F.col("sd").alias("a"), F.col("home").alias("b"))
    return own.filter("a <> b").unionByName(found.select("a", "b"))


def similar_classes(classes: DataFrame, plain: DataFrame, words: int, least: float) -> DataFrame:
    """``a, b``: links between classes (by ``sd``) that connect all that true links among the candidates connect."""
    heads = ordered_heads(plain, words, least)
    found = materialize(candidates(heads, least), "similar-candidates")
    left = heads.select(F.col("sd").alias("a"), "n", F.col("sketch").alias("x"))
    right = heads.select(F.col("sd").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    pairs = found.filter("kind = 0").join(left, "a").join(right, "b").filter(_may_be_similar(least))
    pairs = materialize(pairs.select("a", "b"), "similar-pairs")
    dense = connected_components(found.filter("kind = 1").select("a", "b")).withColumnsRenamed({"id": "sd", "component": "comp"})
    dense = materialize(dense, "similar-dense")
    # shingle sets of those classes only
    needed = pairs.select(F.col("a").alias("sd")).unionByName(pairs.select(F.col("b").alias("sd"))).unionByName(dense.select("sd")).distinct()
    needed = needed.join(classes.select("sd", "rep.id", "rep.th"), "sd").select("id", "th")
    texts = plain.join(needed, ["id", "th"]).dropDuplicates(["id", "th"])
    sets = materialize(shingle_sets(texts, words), "similar-sets")
    both = pairs.join(sets.select(F.col("sd").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("sd").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    checked = both.filter(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b")
    if dense.isEmpty():
        return checked
    sizes = dense.groupBy("comp").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("blocks"))
    cells = dense.join(sizes, "comp").withColumn("own", F.expr("CAST(pmod(xxhash64(sd), blocks) AS INT)"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = cells.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sd")
    cells = cells.join(sets, "sd").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "side")
    return checked.unionByName(cells.mapInArrow(_compare(least), "a long, b long"))


def keep_one(docs: DataFrame, words: int = WORDS, least: float = MIN_SIMILARITY, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the one with the smallest ``doc_id`` stays."""
    own_id, own_th, n = (free_prefix(docs) + name for name in ("id", "th", "n"))
    rows = docs.withColumns({own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), own_th: F.xxhash64(F.coalesce("text", F.lit("")))})
    plain = rows.select(F.col(own_id).alias("id"), F.col(own_th).alias("th"), "text")
    marks = materialize(prints(plain, words), "similar-prints")
    classes = marks.groupBy("sd").agg(F.min(F.struct("id", "th")).alias("rep"))
    classes = materialize(classes, "similar-classes")
    links = print_links(marks, max_distance).unionByName(similar_classes(classes, plain, words, least))
    comp = connected_components(links).withColumnsRenamed({"id": "sd"})
    groups = classes.join(comp, "sd", "left").groupBy(F.coalesce("component", "sd").alias("g")).agg(F.min("rep").alias("rep"))
    # rows with the same id and text: one of them
    copies = marks.groupBy("id", "th").count()
    copies = copies.select(F.col("id").alias(own_id), F.col("th").alias(own_th), F.col("count").alias(n))
    kept = groups.select(F.col("rep.id").alias(own_id), F.col("rep.th").alias(own_th)).join(copies, [own_id, own_th])
    kept = materialize(kept, "similar-kept")
    out = rows.join(kept, [own_id, own_th])
    once = out.filter(F.col(n) == 1)
    if not kept.filter(F.col(n) > 1).isEmpty():
        once = once.unionByName(out.filter(F.col(n) > 1).dropDuplicates([own_id, own_th]))
    return once.select(*docs.columns)
