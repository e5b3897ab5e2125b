"""Substring dedup: matching statistics against compressed FM-indexes, one for each shard.

Every window of ``WINDOW`` words belongs to its minimizer, the smallest hash of ``GRAM`` consecutive words in it, so equal
windows anywhere have equal minimizers. A first pass counts minimizers; a second cuts the stretch of windows around
each repeated one into a segment. Equal segments become one with a count, and segments are dealt to shards by
minimizer: all places where a window occurs meet in one shard. Each shard's segments are indexed by a
compressed FM-index (wavelet matrix over the Burrows-Wheeler transform) and streamed through it by backward search
to find the windows that occur twice or more. A last pass removes the words they cover.

A minimizer with more than ``HOT_SEGMENTS`` different segments is dealt by single windows, counted before. The repeated
minimizers reach the second pass as a bit filter of fixed size; a false hit costs work, never correctness: the counts of
the shards decide.

Cases: a null text has no words; a text of fewer than ``WINDOW`` words loses none. A repeated row's windows all start
elsewhere too, so it loses every word from ``WINDOW`` words up; so does a window that repeats in one text. Long texts
are read in blocks of ``SLICE`` words that overlap, so a text may have any number of words; of the whole text there are
the text itself, 8 bytes for each word while windows are found, and the kept words at the end. An empty table gives an empty result. Only the id and the text
are read. Words are compared by 64-bit and segments by two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm.common import broadcast_value, materialize
from polyspark.llm.fm_index import repeated_windows
from polyspark.llm.sentencepiece_codec import slices

WINDOW = 35
GRAM = 8
#: Bits of the filter of repeated minimizers: its fixed size.
FILTER_BITS = 27
HOT_SEGMENTS = 20_000
SHARD_WORDS = 250_000
#: Segments that a task remembers having given the words of.
MEMO_SEGMENTS = 400_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(35).integers(1, 1 << 63, 256, dtype=np.uint64)
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Stretches:
    """Hashes of any stretch of a sequence of numbers, equal for equal stretches."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(_powers[0]) <= n:
            for k, base in enumerate((_ODD, _INVERSE)):
                _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 20), base))])
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finish((self.sums[end] - self.sums[start]) * _powers[1][start])


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words of each text, from Arrow's own bytes."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    first = inside[1:-1] & ~inside[:-2]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    # a word ends with its text
    first[edge] = inside[1:-1][edge]
    last = inside[1:-1] & ~inside[2:]
    last[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = Stretches(_BYTES[data]).of(start, end) + (end - start).astype(np.uint64)
    return hashes, np.diff(np.searchsorted(start, offsets))


def cuts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces of ``size`` bytes and what is left of the last word of each."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


class Hashed:
    """The words of some texts as hashes, and their segments."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        with np.errstate(over="ignore"):
            self._segment(hashes, sizes, window, gram)

    def _segment(self, hashes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> None:
        used = np.flatnonzero(sizes >= window)
        self.hashes = hashes[np.repeat(sizes >= window, sizes)]
        n = len(self.hashes)
        self.stretches = Stretches(self.hashes)
        first = np.cumsum(sizes[used]) - sizes[used]
        self.doc = self.at = self.start = self.count = self.anchor = np.zeros(0, np.int64)
        if not n:
            return
        grams = self.stretches.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
        # the smallest gram of each window, the leftmost of equal ones: high bits of the hash over the place
        place = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        key = (grams & ~low) | place
        span, reach = window - gram + 1, 1
        m = key
        while reach * 2 <= span:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        m = np.minimum(m[: len(key) - span + 1], m[span - reach : span - reach + len(key) - span + 1])
        anchor = (m & low).astype(np.int64)
        # windows of one document, and runs of windows with the same anchor
        counts = sizes[used] - window + 1
        start = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        doc = np.repeat(used, counts)
        own = anchor[start]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
        self.doc, self.start, self.anchor = doc[new], start[new], own[new]
        self.at = self.start - np.repeat(first, np.bincount(np.searchsorted(used, self.doc), minlength=len(used)))
        self.count = np.diff(np.append(new, len(own)))
        self.minimizer = _finish(grams[self.anchor]).view(np.int64)


#: So many bytes of text, and words of one text, at once: places of words stay below 2 ** 24.
SLICE = 1_000_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Hashed]]:
    """Rows and their segments. A text of over ``SLICE`` words comes in blocks that overlap by ``WINDOW - 1`` words, so each window is in one."""
    for whole in batches:
        for b in slices(whole, "text", SLICE):
            text = b.column("text")
            for row, size in enumerate(pc.binary_length(text).to_pylist()):
                if (size or 0) > 2 * SLICE:
                    break
            else:
                with np.errstate(over="ignore"):
                    hashes, sizes = _words(text)
                yield b, Hashed(hashes, sizes)
                continue
            if row:
                with np.errstate(over="ignore"):
                    hashes, sizes = _words(text.slice(0, row))
                yield b.slice(0, row), Hashed(hashes, sizes)
            # a long text is the last one of its slice
            one, parts = b.slice(row), []
            with np.errstate(over="ignore"):
                for c in cuts(text[row].as_buffer().to_pybytes(), SLICE):
                    parts.append(_words(pa.array([c], pa.binary()))[0])
            hashes = np.concatenate(parts)
            for at in range(0, max(1, len(hashes) - WINDOW + 1), SLICE):
                block = hashes[at : at + SLICE + WINDOW - 1]
                h = Hashed(block, np.array([len(block)]))
                h.at = h.at + at
                yield one, h


def minimizer_counts(docs: DataFrame) -> DataFrame:
    """``h, n``: how often each minimizer was chosen, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h in _pieces(batches):
            if len(h.doc):
                value, n = np.unique(h.minimizer, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def repeat_filter(docs: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each repeated minimizer, by its low bits: 2 ** bits in all, whatever the input."""
    slot = F.expr(f"h & {(1 << bits) - 1}")
    words = minimizer_counts(docs).filter("n > 1").select(slot.alias("s"))
    words = words.groupBy(F.expr("CAST(s >> 6 AS INT)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("w")).toArrow().to_pandas()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words["at"].to_numpy()] = words["w"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def segments(docs: DataFrame, shared, bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, th, at, n_win, h, sd, words`` for each segment with a minimizer in the filter.

    ``th`` hashes the text, ``sd`` the segment; ``words`` (hashes, 8 bytes each) is null where this task has given it before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for b, h in _pieces(batches):
            if not len(h.doc):
                continue
            low = h.minimizer & ((1 << bits) - 1)
            hit = np.flatnonzero(shared.value[low >> 6] >> (low & 63).astype(np.uint64) & np.uint64(1))
            size = h.count[hit] + WINDOW - 1
            with np.errstate(over="ignore"):
                sd = h.stretches.of(h.start[hit], h.start[hit] + size).view(np.int64)
            words = []
            if len(given) > MEMO_SEGMENTS:
                given.clear()
            for s, a, n in zip(sd.tolist(), h.start[hit].tolist(), size.tolist()):
                words.append(None if s in given else h.hashes[a : a + n].tobytes())
                given.add(s)
            doc = pa.array(h.doc[hit])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(doc), b.column("th").take(doc), pa.array(h.at[hit].astype(np.int32)), pa.array(h.count[hit].astype(np.int32)), pa.array(h.minimizer[hit]), pa.array(sd), pa.array(words, pa.binary())],
                ["doc_id", "th", "at", "n_win", "h", "sd", "words"],
            )

    return docs.mapInArrow(run, "doc_id long, th long, at int, n_win int, h long, sd long, words binary")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Indexes and searches each run of rows with one shard number."""
    held: list[pa.RecordBatch] = []
    last = None

    def close() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        words = t.column("words").to_pylist()
        sizes = np.array([len(w) // 8 for w in words], np.int64)
        mask = repeated_windows(np.frombuffer(b"".join(words), np.uint64), sizes, t.column("copies").to_numpy(), WINDOW)
        return pa.RecordBatch.from_arrays([*(t.column(n).combine_chunks() for n in ("h", "sd")), pa.array(mask.view(np.int64))], ["h", "sd", "mask"])

    for b in batches:
        shard = b.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)] if len(shard) else [0]
        for s, e in zip(cuts, cuts[1:]):
            if shard[s] != last and held:
                yield close()
                held = []
            last = shard[s]
            held.append(b.slice(s, e - s))
    if held:
        yield close()


def _matched(rows: DataFrame, words: int) -> DataFrame:
    """``h, sd, mask`` for distinct segments ``h, sd, copies, words`` of about ``words`` words together."""
    shards = max(1, -(-words // SHARD_WORDS))
    rows = rows.withColumn("shard", F.expr(f"CAST(pmod(xxhash64(h), {shards}) AS INT)"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard")
    return rows.select("shard", "h", "sd", "copies", "words").mapInArrow(_search, "h long, sd long, mask long")


def _hot_windows(hot: DataFrame) -> DataFrame:
    """For minimizers with very many different segments: single windows, equal ones counted first."""
    cut = F.expr(f"transform(sequence(0, CAST(length(words) / 8 AS INT) - {WINDOW}), j -> substring(words, j * 8 + 1, {WINDOW * 8}))")
    one = hot.select("h", "sd", "copies", F.posexplode(cut).alias("j", "w")).withColumns({"wh": F.xxhash64("w"), "wd": F.xxhash64(F.lit(1), "w")})
    one = materialize(one, "substring-hot")
    distinct = one.groupBy("wh", "wd").agg(F.sum("copies").alias("copies"), F.min("w").alias("words"))
    distinct = distinct.select(F.col("wh").alias("h"), F.col("wd").alias("sd"), "copies", "words")
    found = _matched(distinct, distinct.count() * WINDOW).filter("mask <> 0").select(F.col("h").alias("wh"), F.col("sd").alias("wd"))
    return one.join(found, ["wh", "wd"]).groupBy("h", "sd").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))


def repeated(docs: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, th, found``: for each document the segments' starts and the bits of the repeated windows in them."""
    bits = repeat_filter(docs)
    found = materialize(segments(docs, broadcast_value(docs.sparkSession, bits, bits.nbytes)), "substring-segments")
    distinct = found.groupBy("h", "sd").agg(F.count("*").alias("copies"), F.max("n_win").alias("n_win"))
    per_h = distinct.groupBy("h").agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"))
    # one text of each distinct segment (a task gives it once)
    texts = found.filter("words IS NOT NULL").groupBy("h", "sd").agg(F.min("words").alias("words"))
    rows = distinct.join(per_h.filter("n > 1"), "h").join(texts, ["h", "sd"])
    rows = materialize(rows.select("h", "sd", "copies", "kinds", "words"), "substring-distinct")
    size = rows.agg(F.sum(F.expr("length(words) DIV 8")).alias("w"), F.max("kinds").alias("k")).first()
    mask = _matched(rows.filter(F.col("kinds") <= hot_segments), size.w or 0)
    if (size.k or 0) > hot_segments:
        mask = mask.unionByName(_hot_windows(rows.filter(F.col("kinds") > hot_segments)))
    mask = materialize(mask.filter("mask <> 0"), "substring-masks")
    hits = found.select("doc_id", "th", "at", "h", "sd").join(mask, ["h", "sd"])
    # equal rows bring the same segments: a set, united before the shuffle, has each once, however many rows there are
    return hits.groupBy("doc_id", "th").agg(F.collect_set(F.struct("at", "mask")).alias("found"))


def _keep(text: str | None, found: list[dict] | None) -> tuple[int, int, bytes]:
    """Words of the text, words gone and the kept ones; words are split a piece of the text at a time."""
    starts = np.sort(np.array([f["at"] + j for f in found or () for j in range(64) if f["mask"] >> j & 1], np.int64))
    n = kept = 0
    out = []
    for piece in cuts((text or "").encode("utf-8", "surrogatepass"), SLICE):
        words = piece.split()
        if len(starts) and words:
            place = np.arange(n, n + len(words))
            # a word is gone where a window starts at it or at one of the WINDOW - 1 words before
            stay = np.searchsorted(starts, place, "right") == np.searchsorted(starts, place - WINDOW + 1, "left")
            n += len(words)
            words = [words[k] for k in np.flatnonzero(stay)]
        else:
            n += len(words)
        kept += len(words)
        if words:
            out.append(b" ".join(words))
    return n, n - kept, b" ".join(out)


def remove_repeats(docs: DataFrame, digest: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row; with ``digest`` the SHA-256 of the kept text instead."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    found = repeated(docs, hot_segments).withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left").select("doc_id", "text", "found")
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", SLICE):
                out = [_keep(t, f) for t, f in zip(b.column("text").to_pylist(), b.column("found").to_pylist())]
                n, gone, text = zip(*out) if out else ((), (), ())
                text = [hashlib.sha256(t).hexdigest() if digest else t.decode("utf-8", "surrogatepass") for t in text]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", last])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {last} string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest=True)
