"""Merkle manifest of a dataset: one tree for each group, their roots in one tree above, a proof for every row.

Rows are sorted by range of (group, order), so a task holds consecutive leaves; counts of groups by partition give the
offset from which a task numbers the leaves of its first group. A task builds every complete aligned subtree of its own run
of leaves (up to ``FANOUT ** LOCAL`` of them) and keeps the leaves with it. Only nodes whose parent a task cannot complete,
at the ragged ends of runs, are shuffled by their coordinate, and upper levels are finished in rounds of ``CLIMB`` levels, so a
task never holds more than ``FANOUT ** CLIMB`` nodes of a tree. Siblings on the way up come back down to the subtrees by
equi-joins, and each leaf gets its path.

A coordinate is (group, level, index): it stands for leaves ``index * FANOUT ** level`` and on. Every ``FANOUT``
consecutive nodes become one, the last ones even if they are fewer; a tree ends where one node remains.

Cases: a null group is a group of its own and comes first; a null in an order column comes first; rows of equal order are ordered
by leaf, and equal leaves are interchangeable. Null fields of a leaf count as ``-`` and differ from empty ones. A hot group is
split among ranges, equal rows as well. Texts enter the leaf only, so long ones are never moved. An empty table gives
an empty result. Extra columns are neither hashed nor kept unless ``carry`` names them, and no name can clash: they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspark.llm.common import broadcast_value, materialize, partitions_for

FANOUT = 3
#: Levels that a task builds by itself, and levels of a later round.
LOCAL = 7
CLIMB = 6
LEAVES_PER_TASK = 200_000

_PATH = "array<struct<left:string,right:string>>"
_STEP = "g string, level int, idx long, path " + _PATH + ", up_level int, up_idx long, up_hash string, ended boolean, lead boolean"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The digest of fields, each as its length in bytes, a colon and its value, or ``-`` for null."""
    text = lambda c: F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    return F.sha2(F.concat(*[F.coalesce(text(c), F.lit("-")) for c in fields]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def climb(nodes: dict[tuple[int, int], str], block: int, top: int) -> tuple[list[dict[int, str]], int]:
    """Levels from 0 to the last one of the tree under coordinate (``top``, ``block``), and that last level.

    ``nodes`` tile the leaves under it without gaps. Under the first block a tree may end below ``top``, where one node remains.
    """
    levels: list[dict[int, str]] = []
    waiting = len(nodes)
    for level in range(top + 1):
        here = {i: h for (at, i), h in nodes.items() if at == level}
        waiting -= len(here)
        if level:
            runs: dict[int, list[str]] = {}
            for i in sorted(levels[-1]):
                runs.setdefault(i // FANOUT, []).append(levels[-1][i])
            here |= {i: digest(run) for i, run in runs.items()}
        levels.append(here)
        if level == top or (block == 0 and not waiting and len(here) == 1):
            return levels, level
    return levels, top


def siblings(levels: list[dict[int, str]], level: int, idx: int, last: int) -> list[tuple[str, str]]:
    """What stands left and right of a node and of its ancestors, up to level ``last``."""
    out = []
    for at in range(level, last):
        first = idx // FANOUT * FANOUT
        run = [levels[at].get(first + k, "") for k in range(FANOUT)]
        out.append(("".join(run[: idx - first]), "".join(run[idx - first + 1 :])))
        idx //= FANOUT
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, the place of a leaf in the part of its group here, and whether that group is the partition's first."""
    pid, n, first, now = TaskContext.get().partitionId(), 0, True, None
    for b in batches:
        if not b.num_rows:
            continue
        groups = b.column("g").to_pylist()
        within, firsts = np.empty(len(groups), np.int64), np.empty(len(groups), bool)
        for k, g in enumerate(groups):
            if g != now:
                first, now, n = now is None, g, 0
            within[k], firsts[k] = n, first
            n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(groups), pid, np.int32)), pa.array(within), pa.array(firsts), *(b.column(c) for c in ("g", "leaf", "carry"))],
            ["pid", "within", "first", "g", "leaf", "carry"],
        )


def _aligned(start: int, stop: int) -> list[tuple[int, int]]:
    """``level, index`` of the largest aligned subtrees that tile ``[start, stop)``."""
    out = []
    while start < stop:
        level = 0
        while level < LOCAL and start % FANOUT ** (level + 1) == 0 and start + FANOUT ** (level + 1) <= stop:
            level += 1
        out.append((level, start // FANOUT**level))
        start += FANOUT**level
    return out


def _subtrees(offsets):
    """Complete aligned subtrees of each run of consecutive leaves, with their leaves."""

    def cut(rows: pa.Table, at: np.ndarray, groups: list[str], ends: np.ndarray) -> pa.RecordBatch:
        leaves, g, level, idx, top, bounds = rows.column("leaf").to_pylist(), [], [], [], [], [0]
        for a, z in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            for lv, i in _aligned(int(at[a]), int(at[a]) + z - a):
                size, base = FANOUT**lv, bounds[-1]
                level.append(lv)
                idx.append(i)
                g.append(groups[a])
                hashes = leaves[base : base + size]
                while len(hashes) > 1:
                    hashes = [digest(hashes[k : k + FANOUT]) for k in range(0, len(hashes), FANOUT)]
                top.append(hashes[0])
                bounds.append(base + size)
        listed = lambda c: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows.column(c).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(top, pa.string()), listed("leaf"), listed("carry")], ["g", "level", "idx", "hash", "leaves", "carried"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            shift = np.array([offsets.value.get(p, 0) for p in rows.column("pid").to_pylist()], np.int64)
            at = rows.column("within").to_numpy() + np.where(rows.column("first").to_numpy(zero_copy_only=False), shift, 0)
            rows = rows.select(["g", "leaf", "carry"]).append_column("at", pa.array(at))
            rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
            at, groups = rows.column("at").to_numpy(), rows.column("g").to_pylist()
            if not groups:
                continue
            new = np.flatnonzero((np.diff(at) != 1) | np.array([x != y for x, y in zip(groups, groups[1:])], bool)) + 1
            ends = np.append(new, len(groups))
            # the unfinished subtree at the end waits for what follows
            last = int(new[-1]) if len(new) else 0
            hold = max(last, len(groups) - (int(at[-1]) + 1) % FANOUT**LOCAL)
            rest = rows.slice(hold)
            if hold > 0:
                ends = np.append(ends[ends < hold], hold)
                yield cut(rows.slice(0, hold), at, groups, ends)
        if rest is not None and rest.num_rows:
            rest = rest.combine_chunks()
            yield cut(rest, rest.column("at").to_numpy(), rest.column("g").to_pylist(), np.array([rest.num_rows]))

    return run


def _finish(top: int):
    """One round: the nodes under a coordinate of level ``top`` become one node; each gets its siblings on the way."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = int(key[1])
        levels, last = climb(dict(zip(zip(rows.level, rows.idx), rows.hash)), block, top)
        (up, root), out = next(iter(levels[last].items())), []
        for k, (g, level, idx) in enumerate(zip(rows.g, rows.level, rows.idx)):
            path = [{"left": a, "right": z} for a, z in siblings(levels, level, idx, last)]
            out.append((g, level, idx, path, last, up, root, last < top, k == 0))
        return pd.DataFrame(out, columns=["g", "level", "idx", "path", "up_level", "up_idx", "up_hash", "ended", "lead"])

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each leaf of a subtree, with its path: first inside the subtree, then the subtree's own."""
    for b in batches:
        for k in range(b.num_rows):
            level, idx = b.column("level")[k].as_py(), b.column("idx")[k].as_py()
            leaves, above = b.column("leaves")[k].values, b.column("path")[k].as_py()
            n, size = len(leaves), FANOUT**level
            rows = [leaves.to_pylist()]
            for _ in range(level):
                rows.append([digest(rows[-1][i : i + FANOUT]) for i in range(0, len(rows[-1]), FANOUT)])
            levels = [dict(enumerate(r)) for r in rows]
            upper = [(p["left"], p["right"]) for p in above]
            left, right = [], []
            for i in range(n):
                for a, z in [*siblings(levels, 0, i, level), *upper]:
                    left.append(a)
                    right.append(z)
            steps = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (level + len(upper)), pa.int32()), steps)
            same = lambda c: pa.array([b.column(c)[k].as_py()] * n, pa.string())  # noqa: B023, E731
            index = pa.array(np.arange(n, dtype=np.int64) + idx * size)
            yield pa.RecordBatch.from_arrays([leaves, b.column("carried")[k].values, index, same("subroot"), same("root"), path], ["leaf", "carry", "index", "subroot", "root", "path"])


def _forest(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over ``g, leaf, carry`` and order columns ``o0``...: subtrees, a path for each subtree, and a root for each group."""
    spark = rows.sparkSession
    order = ["g", *(c for c in rows.columns if c.startswith("o")), "leaf", "tie"]
    keyed = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    tasks = partitions_for(keyed.count(), LEAVES_PER_TASK, spark)
    ordered = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("g", "leaf", "carry")
    carry = ordered.schema["carry"].dataType.simpleString()
    ordered = materialize(ordered.mapInArrow(_number, f"pid int, within long, first boolean, g string, leaf string, carry {carry}"), "merkle-sorted")
    before = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("pid", "g").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    found = counts.withColumn("offset", F.sum("n").over(before)).filter("first AND offset > 0").select("pid", "offset").collect()
    # one number for each partition at most
    offsets = broadcast_value(spark, {r.pid: r.offset for r in found}, 100 * len(found))
    pieces = ordered.mapInArrow(_subtrees(offsets), f"g string, level int, idx long, hash string, leaves array<string>, carried array<{carry}>")
    pieces = materialize(pieces, "merkle-subtrees")
    nodes, top, rounds = pieces.select("g", "level", "idx", "hash"), LOCAL, []
    while True:
        ragged = nodes.filter(F.col("level") < top)
        block = F.floor(F.col("idx") / F.pow(F.lit(FANOUT), F.lit(top) - F.col("level"))).cast("long").alias("block")
        step = materialize(ragged.groupBy("g", block).applyInPandas(_finish(top), _STEP), "merkle-round")
        rounds.append(step)
        up = step.filter("lead AND NOT ended").select("g", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.col("up_hash").alias("hash"))
        nodes = nodes.filter(F.col("level") >= top).unionByName(up)
        if nodes.isEmpty():
            break
        top += CLIMB
    full = None
    for step in reversed(rounds):
        if full is None:
            done = step.select("g", "level", "idx", "path", F.col("up_hash").alias("subroot"))
        else:
            above = full.select("g", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("path").alias("above"), "subroot")
            both = step.join(above, ["g", "up_level", "up_idx"], "left")
            done = both.select("g", "level", "idx", F.when(F.col("ended"), F.col("path")).otherwise(F.concat("path", "above")).alias("path"), F.when(F.col("ended"), F.col("up_hash")).otherwise(F.col("subroot")).alias("subroot"))
        done = materialize(done, "merkle-paths")
        full = done if full is None else full.unionByName(done)
    roots = None
    for step in rounds:
        one = step.filter("lead AND ended").select("g", F.col("up_hash").alias("subroot"))
        roots = one if roots is None else roots.unionByName(one)
    return pieces, full, roots


def prove(rows: DataFrame, group: str, order: list[str], leaf: str, carry: list[str]) -> DataFrame:
    """Returns ``carry``, ``leaf``, ``index`` (place in its group), ``subroot``, ``root`` and ``path`` for every row.

    ``path`` is an array of ``left, right``: the joined digests of the siblings at each level, from the leaf's own run by its group's
    root to the root. ``group`` is a string column.
    """
    g = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group))
    keyed = rows.select(g.alias("g"), *[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.col(leaf).alias("leaf"), F.struct(*carry).alias("carry"))
    pieces, paths, roots = _forest(keyed)
    upper, above, top = _forest(roots.select(F.lit("").alias("g"), F.col("g").alias("o0"), F.col("subroot").alias("leaf"), F.struct("g").alias("carry")))
    top = top.select(F.col("subroot").alias("root"))
    groups = upper.join(above, ["g", "level", "idx"]).crossJoin(F.broadcast(top)).mapInArrow(_expand, _rows("struct<g:string>"))
    groups = materialize(groups.select("carry.g", "path", "root"), "merkle-groups").withColumnRenamed("path", "upper")
    paths = paths.join(groups, "g").select("g", "level", "idx", "subroot", "root", F.concat("path", "upper").alias("path"))
    whole = pieces.join(paths, ["g", "level", "idx"]).mapInArrow(_expand, _rows(keyed.schema["carry"].dataType.simpleString()))
    return whole.select("carry.*", F.col("leaf").alias(leaf), "index", "subroot", "root", "path")


def _rows(carry: str) -> str:
    return f"leaf string, carry {carry}, index long, subroot string, root string, path {_PATH}"


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    fields = lambda text: leaf_of(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(changed, fields(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", "source", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    out = prove(rows, "source", ["doc_id"], "leaf", ["doc_id", "tampered"])
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf(text: str) -> str:
    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    return f"sha256({' || '.join(part.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# the check sum bit by bit: each character of the id, then eight shifts
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: list_concat([ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT],
    [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"""
SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS g, {_leaf('text')} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents
), leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d
), tree AS (
  SELECT g, 0 AS lvl, idx, leaf AS h FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM tree) WHERE c > 1 GROUP BY g, lvl, idx // 3
), sub AS (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS subroot FROM tree GROUP BY g
), groups AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS gi FROM sub
), upper AS (
  SELECT 0 AS lvl, gi AS idx, subroot AS h FROM groups
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS c FROM upper) WHERE c > 1 GROUP BY lvl, idx // 3
), whole AS (SELECT max(lvl) AS top, arg_max(h, lvl) AS root FROM upper
), steps AS (
  SELECT r, l.lvl, t.idx AS place, own, h FROM (SELECT r, g, unnest(range(0, top)) AS lvl, idx FROM leaves JOIN sub USING (g)) l,
    LATERAL (SELECT l.idx // pow(3, l.lvl)::BIGINT AS own) o JOIN tree t ON t.g = l.g AND t.lvl = l.lvl AND t.idx // 3 = o.own // 3
  UNION ALL
  SELECT r, 1000 + l.lvl, t.idx, own, h FROM (SELECT r, gi, unnest(range(0, whole.top)) AS lvl FROM leaves JOIN groups USING (g), whole) l,
    LATERAL (SELECT l.gi // pow(3, l.lvl)::BIGINT AS own) o JOIN upper t ON t.lvl = l.lvl AND t.idx // 3 = o.own // 3
), sides AS (
  SELECT r, lvl, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place < own), '') AS a, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place > own), '') AS z FROM steps GROUP BY r, lvl
), paths AS (SELECT r, list(a || '|' || z ORDER BY lvl) AS path, string_agg(a || z, '' ORDER BY lvl) AS proof FROM sides GROUP BY r
), out AS (
  SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(tampered, leaf)], coalesce(path, [])), lambda x, s: sha256(split_part(s, '|', 1) || x || split_part(s, '|', 2))) AS folded_root
  FROM leaves JOIN groups USING (g) LEFT JOIN paths USING (r), whole
)
SELECT *, folded_root = root AS verified FROM out
"""
