"""Alignment of two tokenizers: which tokens of A and B overlap, in DuckDB over the token intervals of an Arrow partition.

Both tokenizers cover the bytes of a space and the text. A text is cut into units, in front of spaces that follow a character that is
no white space: no pre-token of A and no piece of B goes on across such a place (checked for the vocabulary), so both have a token end
there. A task codes and aligns each distinct unit once and remembers up to ``MEMO_UNITS``. New units go to DuckDB together, as token
intervals end to end: two ASOF joins find the first and the last B token that overlap each A token and the range between them gives
the links; an equi-join of ends gives the cuts, and window sums of cuts number the groups. Documents sum over their units.

Each document's distinct pairs are written once. Partial counts of pairs (documents that hold them linked) are merged in Spark. Pairs above a
share of all (document, pair) rows, fewer than ``HOT_PAIRS`` by that share, are broadcast and summed in the tasks; all other
pairs leave the task as (document, pair, number) and meet their counts in a shuffle in which no pair has more than that share.

Cases: a null or empty text, or one whose token bytes differ from its own (such as one with U+2581, which B takes for a space),
has no tokens: zeros and no groups. Repeated rows are documents of their own. A very long text is taken in blocks of units. An
empty table gives an empty result. Only ``key`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyspark.llm.common import broadcast_value, materialize
from polyspark.llm.sentencepiece_codec import MARK, slices

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 3 << 20
#: Units that a task remembers; when there are more it starts afresh.
MEMO_UNITS = 600_000
#: Pairs above this share of all rows are broadcast; there are fewer of them than this.
HOT_PAIRS = 1 << 20
DUCKDB_MEMORY = "200MB"
#: Characters of a text whose units are held at once.
BLOCK_CHARS = 1 << 20
#: Spaces in a row, or after other white space: such texts are cut with more care.
_SPACES = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next free code from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Models:
    """The files of both tokenizers, read on the driver."""

    a: str
    b: bytes

    def n_bytes(self) -> int:
        return len(self.a) + len(self.b)


def load_models(path_a: str = MODEL_A, path_b: str = MODEL_B) -> Models:
    with open(path_a, encoding="utf-8") as fa, open(path_b, "rb") as fb:
        return Models(fa.read(), fb.read())


class Coder:
    """Both tokenizers in a task, with the bytes of every token."""

    def __init__(self, models: Models):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(models.a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=models.b)
        letters = byte_letters()
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else b"" for i in range(max(names) + 1)]
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a space, so texts cannot be cut in front of one")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(MARK)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units, each of which starts with the space that B puts in front by itself."""
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] for u in units], num_threads=1)
        # of an empty text B makes nothing, not even its space
        return a, [ids if len(u) > 1 else [self.space] for u, ids in zip(units, b)]

    def encode_row(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that end in no white space, one behind the other as a single text; none if their bytes are not the text's."""
        whole = "".join(units)
        # without the offsets, which cost as much again
        a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        b = self.b.encode(whole[1:])
        raw = whole.encode()
        if b"".join([self.bytes_a[i] for i in a]) != raw or b"".join([self.bytes_b[i] for i in b]) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def blocks_of(text: str) -> Iterator[list[str]]:
    """The units of a space and the text, in blocks of about ``BLOCK_CHARS``."""
    whole, at = " " + text, 0
    while at < len(whole):
        cut = _CUT.search(whole, at + BLOCK_CHARS) if len(whole) - at > BLOCK_CHARS else None
        end = cut.start() if cut else len(whole)
        part = whole if at == 0 and end == len(whole) else whole[at:end]
        yield _CUT.split(part) if _SPACES.search(part) else [" " + w for w in part[1:].split(" ")]
        at = end


def units_of(text: str) -> list[str]:
    return [u for block in blocks_of(text) for u in block]


_LINKS = """
WITH lo AS (SELECT a.k, a.u, a.id, a.e, b.k AS lo FROM a ASOF JOIN b ON a.s >= b.s),
     hi AS (SELECT lo.k, lo.u, lo.id, lo.lo, b.k AS hi FROM lo ASOF JOIN b ON lo.e > b.s),
     wide AS (SELECT u, id, unnest(range(lo, hi + 1)) AS k FROM hi)
SELECT wide.u, (wide.id::BIGINT << 32) + b.id AS pair FROM wide JOIN b ON wide.k = b.k ORDER BY wide.u
"""
_GROUPS = """
WITH ga AS (SELECT a.u, a.id, a.k, sum((b.e IS NOT NULL)::INT) OVER (ORDER BY a.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM a LEFT JOIN b ON a.e = b.e),
     gb AS (SELECT b.u, b.id, b.k, sum((a.e IS NOT NULL)::INT) OVER (ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM b LEFT JOIN a ON a.e = b.e)
SELECT u::BIGINT AS u, coalesce(g, 0)::BIGINT AS g, side, id FROM (SELECT u, g, 0 AS side, k, id FROM ga UNION ALL SELECT u, g, 1, k, id FROM gb) ORDER BY 2, side, k
"""
_COUNT = "SELECT pair, count(*) AS n FROM incoming GROUP BY pair"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_COLD = "array<struct<pair:bigint,m:bigint>>"


class _Numbers(dict):
    """The number of each unit; one that is asked for first gets the next and is put among the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class _Units:
    """What a task knows of units: sizes, the text of their groups, and the pairs of their links one behind the other."""

    def __init__(self, models: Models):
        self.coder = Coder(models)
        self.length_a = np.array([len(x) for x in self.coder.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.coder.bytes_b], np.int64)
        # how an id is written as the first of a unit, behind the ids of A, in a new group, and behind an id of its side
        self.names = [[f"{mark}{i}" for i in range(max(len(self.length_a), len(self.length_b)))] for mark in ("", "|", ";", ",")]
        self.reset()

    def reset(self) -> None:
        self.number = _Numbers()
        self.texts: list[str] = []
        # by unit: tokens of A and of B, groups, links, whether the bytes are right, and where its links begin
        self.sizes = np.zeros((0, 4), np.int64)
        self.ok = np.zeros(0, bool)
        self.first_link = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def numbers(self, blocks: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the units of each block; new units are coded and aligned first."""
        if len(self.number) > MEMO_UNITS:
            self.reset()
        get = self.number.__getitem__
        found = [np.fromiter(map(get, block), np.int64, len(block)) for block in blocks]
        if self.number.new:
            self._learn(self.number.new)
            self.number.new = []
        return found

    def _code(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of A and B one behind the other, each with its unit, and which units are right."""
        rank = {u: k for k, u in enumerate(units)}
        plain = [u for u in units if not u[-1].isspace() and MARK not in u]
        rest = [u for u in units if u[-1].isspace() or MARK in u]
        ok, out = np.zeros(len(units), bool), []
        row = self.coder.encode_row(plain) if plain else (np.zeros(0, np.int64),) * 2
        if row is None:
            rest, plain, row = units, [], (np.zeros(0, np.int64),) * 2
        ends = np.cumsum([len(u.encode()) for u in plain]) if plain else np.zeros(0, np.int64)
        order = np.array([rank[u] for u in plain], np.int64)
        ok[order] = True
        for ids, lengths in zip(row, (self.length_a, self.length_b)):
            at = np.cumsum(lengths[ids])
            out.append((ids, order[np.searchsorted(ends, at)] if len(ids) else ids))
        if rest:
            a, b = self.coder.encode(rest)
            for u, x, y in zip(rest, a, b):
                raw = u.encode()
                ok[rank[u]] = b"".join([self.coder.bytes_a[i] for i in x]) == raw == b"".join([self.coder.bytes_b[i] for i in y])
            right = [k for k, u in enumerate(rest) if ok[rank[u]]]
            for side, coded in enumerate((a, b)):
                ids = np.array([i for k in right for i in coded[k]], np.int64)
                which = np.array([rank[rest[k]] for k in right for _ in coded[k]], np.int64)
                out[side] = (np.concatenate([out[side][0], ids]), np.concatenate([out[side][1], which]))
        return (*out, ok)

    def _learn(self, units: list[str]) -> None:
        import duckdb

        (a, of_a), (b, of_b), ok = self._code(units)
        n = len(units)
        with duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": f"{tempfile.gettempdir()}/duckdb-{uuid.uuid4().hex}"}) as db:
            for name, ids, which, lengths in (("a", a, of_a, self.length_a), ("b", b, of_b, self.length_b)):
                ends = np.cumsum(lengths[ids])
                db.register("incoming", pa.table({"k": np.arange(len(ids)), "u": which, "id": ids, "s": ends - lengths[ids], "e": ends}))
                db.execute(f"CREATE TEMP TABLE {name} AS SELECT * FROM incoming")
            links = db.sql(_LINKS).fetchnumpy()
            tokens = db.sql(_GROUPS).fetchnumpy()
        n_links = np.bincount(links["u"], minlength=n)
        u, g, side, ids = (np.asarray(tokens[c]) for c in ("u", "g", "side", "id"))
        texts, groups = [""] * n, np.zeros(n, np.int64)
        if len(u):
            start = np.concatenate([[True], u[1:] != u[:-1]])
            turn = np.concatenate([[0], side[1:] - side[:-1]])
            mark = np.where(start, 0, np.where(turn > 0, 1, np.where(turn < 0, 2, 3)))
            names = self.names
            parts = [names[m][i] for m, i in zip(mark.tolist(), ids.tolist())]
            bounds = [*np.flatnonzero(start).tolist(), len(u)]
            for x, z in zip(bounds, bounds[1:]):
                texts[u[x]] = "".join(parts[x:z])
            groups = np.bincount(u[np.concatenate([[True], g[1:] != g[:-1]])], minlength=n)
        sizes = np.column_stack([np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), groups, n_links]).astype(np.int64)
        self.first_link = np.concatenate([self.first_link, len(self.pairs) + np.cumsum(n_links) - n_links])
        self.pairs = np.concatenate([self.pairs, np.asarray(links["pair"], np.int64)])
        self.sizes, self.ok = np.vstack([self.sizes, sizes]), np.concatenate([self.ok, ok])
        self.texts += texts

    def pairs_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the links of these units, and how often each occurs."""
        counts = self.sizes[units, 3]
        at = np.repeat(self.first_link[units] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        return np.unique(self.pairs[at], return_counts=True)


_UNITS: dict[int, _Units] = {}


def _known(shared) -> _Units:
    """The units of this Python process: later tasks go on with them."""
    if shared.value.n_bytes() not in _UNITS:
        _UNITS.clear()
        _UNITS[shared.value.n_bytes()] = _Units(shared.value)
    return _UNITS[shared.value.n_bytes()]


def _document(known: _Units, units: list[np.ndarray], digest: bool) -> tuple[list[int], str, np.ndarray, np.ndarray] | None:
    """Sizes, groups, distinct pairs and their numbers of a text; none where a unit's bytes are wrong."""
    if not units or not all(known.ok[x].all() for x in units):
        return None
    sizes = sum(known.sizes[x].sum(axis=0) for x in units).tolist()
    texts = known.texts
    joined = (";".join([texts[i] for i in x.tolist()]) for x in units)
    if digest:
        h, first = sha256(), True
        for part in joined:
            h.update((part if first else ";" + part).encode())
            first = False
        groups = h.hexdigest()
    else:
        groups = ";".join(joined)
    pairs, times = known.pairs_of(units[0])
    for x in units[1:]:
        more, again = known.pairs_of(x)
        pairs, where = np.unique(np.concatenate([pairs, more]), return_inverse=True)
        times = np.bincount(where, np.concatenate([times, again])).astype(np.int64)
    return sizes, groups, pairs, times


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def _align(shared, digest: bool):
    none = ([0, 0, 0, 0], "", np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(shared)
        for whole in batches:
            for b in slices(whole, "text", SLICE_BYTES):
                blocks = [[*blocks_of(t)] if t else [] for t in b.column("text").to_pylist()]
                numbers = iter(known.numbers([x for doc in blocks for x in doc]))
                rows = [_document(known, [next(numbers) for _ in doc], digest) or none for doc in blocks]
                sizes = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)]
                columns = [b.column("key"), *sizes, pa.array([r[1] for r in rows], pa.string()), _lists([r[2] for r in rows]), _lists([r[3] for r in rows])]
                yield pa.RecordBatch.from_arrays(columns, ["key", *NUMBERS[:4], "groups", "pairs", "times"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": f"{tempfile.gettempdir()}/duckdb-{uuid.uuid4().hex}"}) as db:
        for b in batches:
            db.register("incoming", pa.table({"pair": b.column("pairs").flatten()}))
            got = db.sql(_COUNT).fetchnumpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(got[c], np.int64)) for c in ("pair", "n")], ["pair", "n"])


def aligned(docs: DataFrame, models: Models | None = None, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, key, n_a, n_b, n_groups, n_links, groups`` and the distinct ``pairs`` of every row with their ``times``: a written table."""
    models = models or load_models()
    shared = broadcast_value(docs.sparkSession, models, models.n_bytes())
    kind = docs.select(key).schema[key].dataType.simpleString()
    sizes = "".join(f", {c} long" for c in NUMBERS[:4])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.mapInArrow(_align(shared, digest), f"key {kind}{sizes}, groups string, pairs array<long>, times array<long>")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")


def _merged(rows: DataFrame) -> DataFrame:
    return rows.select("pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, models: Models | None = None, text: str = "text") -> DataFrame:
    """``a, b, n``: in how many documents a token of A and one of B overlap."""
    rows = aligned(docs.select(F.lit(1).alias("key"), F.col(text).alias("text")), models, True, "key", "text")
    return _merged(rows).select(_a().alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n")


def _a():
    return F.shiftright("pair", 32).cast("int")


def _look_up(hot):
    cold = pa.list_(pa.struct([("pair", pa.int64()), ("m", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = (hot.value[c] for c in ("pair", "n", "best"))
        for b in batches:
            pairs, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            bounds = np.concatenate([[0], np.cumsum(np.array(pa.compute.list_value_length(b.column("pairs")).to_pylist(), np.int64))])
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            n, top = (np.where(found, x[at] if len(keys) else 0, 0) for x in (counts, best))
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])  # noqa: B023, E731
            rest = np.flatnonzero(~found)
            left = pa.StructArray.from_arrays([pa.array(pairs[rest]), pa.array(times[rest])], ["pair", "m"])
            left = pa.ListArray.from_arrays(pa.array(np.searchsorted(rest, bounds).astype(np.int32)), left).cast(cold)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(total(times * top)), pa.array(total(times * n)), left], ["row", "n_best", "count_sum", "cold"])

    return run


def align(docs: DataFrame, models: Models | None = None, digest: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row.

    ``groups`` has the ids of A and B of each group, as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of that.
    ``n_best`` are the links whose pair has the highest count of all pairs of its A token, ``count_sum`` is the sum of the links' counts.
    """
    spark = docs.sparkSession
    rows = aligned(docs, models, digest, key, text)
    pairs = materialize(_merged(rows), "pair-counts").withColumn("a", _a())
    # a row for each token of A at most
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    pairs = pairs.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    common = (F.col("n") * HOT_PAIRS) > total
    found = pairs.filter(common).toArrow().sort_by("pair")
    hot = broadcast_value(spark, {c: found.column(c).to_numpy() for c in ("pair", "n", "best")}, found.nbytes)
    sums = rows.select("row", "pairs", "times").mapInArrow(_look_up(hot), f"row long, n_best long, count_sum long, cold {_COLD}")
    sums = materialize(sums, "pair-sums")
    cold = sums.select("row", F.inline("cold")).join(pairs.filter(~common), "pair")
    cold = cold.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m"))).alias("cold_best"), F.sum(F.col("m") * F.col("n")).alias("cold_sum"))
    rows = rows.select("row", F.col("key").alias(key), *NUMBERS[:4], "groups").join(sums.drop("cold"), "row").join(cold, "row", "left")
    plus = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("long").alias(c)
    return rows.select(key, *NUMBERS[:4], plus("n_best", "cold_best"), plus("count_sum", "cold_sum"), "groups")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, digest=True).withColumnRenamed("groups", "groups_sha256")
