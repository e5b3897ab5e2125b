"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

Spaces become the piece space mark and one is put in front, so decoding gives back every text exactly. The
automaton yields, at each end position, all pieces that end there (by following output links); each relaxes the
best score at its end. A character without a piece is spelt as byte pieces. Of equal scores the longer last piece
wins. Texts are cut where no piece can cross (in front of a run of marks), and each part is segmented once per
distinct string of a task: memory is bounded by ``MEMO_PARTS``. ``encode_column`` gives the same ids for a whole
column: its distinct parts go through the same Viterbi side by side, over a trie in flat arrays.

Cases: a null text has null ids and is counted as no pieces; an empty text has an empty list. A literal mark
U+2581 in a text is spelt in bytes, so that it stays apart from a space. Rows are coded one by one, so
repeated rows, very long texts and other columns need no care.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import inf
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from polyspark.llm.common import broadcast_value

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a literal mark while a text is cut up; a lone surrogate is in no text that Arrow hands over.
ESCAPED = "\ud800"
MEMO_PARTS = 400_000
#: Longest string whose parts are remembered.
MEMO_CHARS = 64
#: Parts of like length that ``encode_column`` segments side by side.
PARTS_AT_ONCE = 1 << 14


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in id order with scores; ``byte_ids[b]`` is the id of the piece for byte ``b``."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    usable: tuple[bool, ...]
    byte_ids: tuple[int, ...]

    def n_bytes(self) -> int:
        return sum(len(p.encode()) + 120 for p in self.pieces)


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads the pieces on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(n))
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    if any(not sp.is_byte(i) for i in byte_ids):
        raise ValueError("the vocabulary lacks byte pieces")
    return Vocabulary(pieces, tuple(sp.get_score(i) for i in range(n)), tuple(not x and bool(p) for x, p in zip(special, pieces)), byte_ids)


def _two_bytes(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}H", *ids)


class _Coded(dict):
    """The bytes of each part, coded when it is first asked for; long ones are not remembered.

    When half the bound is reached the parts become the old ones: those that are asked for again move back.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.old: dict[str, bytes] = {}

    def __missing__(self, s: str) -> bytes:
        codec = self.codec
        raw = self.old.get(s)
        if raw is not None:
            self[s] = raw
            return raw
        if "\n" in s and codec.line_end is not None:
            raw = _two_bytes(codec.line_end).join([self[x] if x else b"" for x in s.split("\n")])
        else:
            raw = _two_bytes(codec.viterbi(s))
        if len(s) <= MEMO_CHARS:
            self[s] = raw
        return raw


class _Trie:
    """The pieces spelt with ``singles`` as a trie in flat arrays, to walk many parts side by side.

    The child of node ``x`` by a character of class ``c`` is ``base[x] + c`` if ``parent`` there is ``x``; the root is 0.
    Class 0 stands for the end of a part and for characters without a piece: no node has such a child.
    """

    def __init__(self, v: Vocabulary, singles: set[str]):
        classes = {c: k for k, c in enumerate(sorted(singles), 1)}
        self.class_of = np.zeros(0x110000, np.int32)
        self.class_of[[ord(c) for c in classes]] = list(classes.values())
        children, ends = [{}], {}
        for i, (piece, ok) in enumerate(zip(v.pieces, v.usable)):
            if ok and singles.issuperset(piece):
                node = 0
                for c in map(classes.__getitem__, piece):
                    below = children[node]
                    node = below.get(c)
                    if node is None:
                        node = below[c] = len(children)
                        children.append({})
                ends[node] = i, len(piece)
        # nodes with many children first, so that a place for all of them is soon found
        size = 4 * len(children) + len(classes) + 1
        place, parent, base = [0] * len(children), [-1] * size, [0] * size
        rng, homes = random.Random(0), size - len(classes)
        inner = sorted((k for k, x in enumerate(children) if x), key=lambda k: -len(children[k]))
        start = [0] * len(children)
        for k in inner:
            at = rng.randrange(homes)
            while at == 0 or any(parent[at + c] >= 0 for c in children[k]):
                at = rng.randrange(homes)
            start[k] = at
            for c, child in children[k].items():
                parent[at + c], place[child] = k, at + c
        for k in inner:
            base[place[k]] = start[k]
        self.base = np.array(base, np.int32)
        self.parent = np.array([place[k] if k >= 0 else -1 for k in parent], np.int32)
        self.score = np.full(size, -inf)
        self.piece, self.length = np.zeros(size, "<u2"), np.zeros(size, np.int32)
        for node, (i, n) in ends.items():
            self.score[place[node]], self.piece[place[node]], self.length[place[node]] = v.scores[i], i, n

    def segment(self, classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best pieces of parts, joined, and how many each part has: ``Codec.viterbi`` for all parts at once.

        ``classes`` are those of all characters, ``sizes`` the parts' lengths, descending. Of equal scores the longer last
        piece wins, since earlier starts come first.
        """
        n, longest = len(sizes), int(sizes[0])
        ends = np.cumsum(sizes)
        grid = np.zeros((longest, n), np.int32)
        grid[np.arange(len(classes)) - np.repeat(ends - sizes, sizes), np.repeat(np.arange(n), sizes)] = classes
        best, came = np.full((longest + 1, n), -inf), np.zeros((longest + 1, n), np.int32)
        best[0] = 0.0
        for i in range(longest):
            at = np.arange(np.searchsorted(-sizes, -i))
            node = self.base[0] + grid[i].take(at)
            for end in range(i + 1, longest + 1):
                score = best[i].take(at) + self.score.take(node)
                better = np.flatnonzero(score > best[end].take(at))
                best[end][at.take(better)], came[end][at.take(better)] = score.take(better), node.take(better)
                if end == longest:
                    break
                below = self.base.take(node) + grid[end].take(at)
                go = np.flatnonzero(self.parent.take(below) == node)
                if not len(go):
                    break
                at, node = at.take(go), below.take(go)
        steps, left, todo = [], sizes.copy(), np.flatnonzero(sizes)
        counts = np.zeros(n, np.int64)
        while len(todo):
            node = came[left[todo], todo]
            steps.append((todo, node))
            counts[todo] += 1
            left[todo] -= self.length[node]
            todo = todo[left[todo] > 0]
        out, last = np.empty(counts.sum(), "<u2"), np.cumsum(counts) - 1
        for k, (which, node) in enumerate(steps):
            out[last[which] - k] = self.piece[node]
        return out, counts


def _binary(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = offsets.astype(np.int64 if pa.types.is_large_binary(kind) else np.int32)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])


class Codec:
    """Built once per Python worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.automaton = ahocorasick.Automaton()
        self.unknown = min(v.scores) - 10.0
        self.crossing = any(MARK in p.lstrip(MARK) for p, ok in zip(v.pieces, v.usable) if ok)
        for i, (piece, score, ok) in enumerate(zip(v.pieces, v.scores, v.usable)):
            if ok:
                self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, ok in zip(v.pieces, v.usable) if ok and len(p) == 1}
        #: How a line end is spelt if no piece has one: texts can then be cut there as well.
        self.line_end = None if any("\n" in p for p, ok in zip(v.pieces, v.usable) if ok) else [v.byte_ids[10]]
        self.memo: dict[str, list[int]] = {}
        self.coded = _Coded(self)
        self.byte_of = {i: b for b, i in enumerate(v.byte_ids)}
        self.text_of = [p.replace(MARK, " ") if ok else "" for p, ok in zip(v.pieces, v.usable)]

    def viterbi(self, s: str) -> list[int]:
        if not self.singles.issuperset(s):
            return self._viterbi_unknown(s)
        # best[end] is the score up to and with character ``end``; the start, index -1, is the last entry
        n = len(s)
        best, came = [-inf] * n + [0.0], [None] * n
        for end, step in self.automaton.iter(s):
            score = best[end - step[1]] + step[2]
            if score > best[end]:
                best[end], came[end] = score, step
        out, at = [], n - 1
        while at >= 0:
            i, length, _ = came[at]
            out.append(i)
            at -= length
        out.reverse()
        return out

    def _viterbi_unknown(self, s: str) -> list[int]:
        """As above, with byte pieces for characters that have no piece."""
        out: list[int] = []
        best, came, at = [0.0] + [-inf] * len(s), [None] * len(s), 0
        for end, step in self.automaton.iter(s):
            at = self._relax_unknown(s, best, came, at, end)
            score = step[2] + best[end + 1 - step[1]]
            if score > best[end + 1]:
                best[end + 1], came[end] = score, step
        self._relax_unknown(s, best, came, at, len(s))
        at = len(s)
        while at:
            i, length, _ = came[at - 1]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.v.byte_ids[b] for b in reversed(s[at - 1].encode("utf-8", "surrogatepass")))
            at -= length
        out.reverse()
        return out

    def _relax_unknown(self, s: str, best: list[float], came: list, at: int, end: int) -> int:
        """Relaxes the characters without a piece in ``s[at:end]``; all matches that end there are done."""
        for k in range(at, end):
            if s[k] not in self.singles and best[k] + self.unknown > best[k + 1]:
                best[k + 1], came[k] = best[k] + self.unknown, (-1, 1, 0.0)
        return max(at, end)

    def part(self, s: str) -> list[int]:
        if self.line_end is not None and "\n" in s:
            first, *rest = s.split("\n")
            out = list(self.part(first)) if first else []
            for x in rest:
                out += self.line_end + (self.part(x) if x else [])
            return out
        if len(s) > MEMO_CHARS:
            return self.viterbi(s)
        ids = self.memo.get(s)
        if ids is None:
            if len(self.memo) >= MEMO_PARTS:
                self.memo.clear()
            ids = self.memo[s] = self.viterbi(s)
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids of ``encode`` as little-endian numbers of two bytes; parts that were met before are joined without a loop."""
        if not text or MARK in text or self.crossing:
            return _two_bytes(self.encode(text))
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = self._parts(text)
        else:
            parts = (MARK + text.replace(" ", " " + MARK)).split(" ")
        if len(self.coded) >= MEMO_PARTS // 2:
            self.coded.old = dict(self.coded)
            self.coded.clear()
        return b"".join(map(self.coded.__getitem__, parts))

    @cached_property
    def trie(self) -> _Trie:
        return _Trie(self.v, self.singles)

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """``encode_bytes`` of a column (null: no bytes): each part that differs is segmented once, many side by side."""
        known = pc.fill_null(pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring(texts, MARK))), False)
        known = known.to_numpy(zero_copy_only=False) & (not self.crossing)
        if not known.any():
            return pa.array([self.encode_bytes(t or "") for t in texts.to_pylist()], pa.binary())
        plain = self._encode_plain(texts.filter(pa.array(known)))
        if known.all():
            return plain
        other = pa.array([self.encode_bytes(t or "") for t in texts.filter(pa.array(~known)).to_pylist()], pa.binary())
        at = np.empty(len(known), np.int64)
        at[np.flatnonzero(known)] = np.arange(len(plain))
        at[np.flatnonzero(~known)] = len(plain) + np.arange(len(other))
        return pa.concat_arrays([plain, other]).take(pa.array(at))

    def _encode_plain(self, texts: pa.Array) -> pa.Array:
        """For texts without a literal mark that are not empty. Parts are cut in bytes: 0xFF is in no text."""
        cut, mark = b"\xff", MARK.encode()
        marked = pc.replace_substring(texts.cast(pa.large_binary()), b" ", cut + mark)
        marked = pc.replace_substring(pc.binary_replace_slice(marked, 0, 0, mark), mark + cut, mark)
        if self.line_end is not None:
            marked = pc.replace_substring(marked, b"\n", cut + b"\n" + cut)
        parts = pc.split_pattern(marked, cut)
        words = parts.values.dictionary_encode()
        coded, place = self._code_parts(words.dictionary.cast(pa.large_string()).to_pylist())
        joined = coded.take(pa.array(place[words.indices.to_numpy()]))
        # what is taken lies end to end, so a text's bytes are those from its first part to its last
        offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)
        return _binary(joined.buffers()[2], offsets[parts.offsets.to_numpy()], pa.binary())

    def _code_parts(self, parts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The bytes of the parts, and the place of each part among them."""
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-sizes, kind="stable")
        n_long = int((sizes > MEMO_CHARS).sum())
        out, counts, places = [], [], []

        def one_by_one(which: np.ndarray) -> None:
            ids = [self.viterbi(parts[k]) for k in which.tolist()]
            out.extend(np.array(x, "<u2") for x in ids)
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            places.append(which)

        one_by_one(order[:n_long])
        for k in range(n_long, len(order), PARTS_AT_ONCE):
            some = order[k : k + PARTS_AT_ONCE]
            size = sizes[some]
            classes = self.trie.class_of[np.frombuffer("".join([parts[i] for i in some.tolist()]).encode("utf-32-le"), np.uint32)]
            fits = np.ones(len(some), bool)
            fits[np.repeat(np.arange(len(some)), size)[classes == 0]] = False
            if fits.any():
                ids, count = self.trie.segment(classes[np.repeat(fits, size)], size[fits])
                out.append(ids)
                counts.append(count)
                places.append(some[fits])
            one_by_one(some[~fits])
        place = np.empty(len(parts), np.int64)
        place[np.concatenate(places)] = np.arange(len(parts))
        offsets = 2 * np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return _binary(np.concatenate(out), offsets, pa.large_binary()), place

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if MARK in text:
            return self._encode_escaped(text)
        if self.crossing:
            return self.viterbi(MARK + text.replace(" ", MARK))
        out: list[int] = []
        get, extend = self.memo.get, out.extend
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = self._parts(text)
        else:
            parts = [MARK + w for w in text.split(" ")]
        for w in parts:
            ids = get(w)
            extend(self.part(w) if ids is None else ids)
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """Runs of marks with what follows up to the next mark."""
        marks = 1
        for w in text.split(" "):
            if w:
                yield MARK * marks + w
                marks = 1
            else:
                marks += 1
        if marks > 1:
            yield MARK * (marks - 1)

    def _encode_escaped(self, text: str) -> list[int]:
        """For texts with a literal mark: it is spelt in bytes, and what stands between is coded by itself."""
        spelt = [self.v.byte_ids[b] for b in MARK.encode()]
        out: list[int] = []
        for k, between in enumerate((MARK + text.replace(MARK, ESCAPED).replace(" ", MARK)).split(ESCAPED)):
            out += (spelt if k else []) + self.viterbi(between)
        return out

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        text_of, byte_of = self.text_of, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([text_of[i] for i in ids])[1:]
        out, raw = [], bytearray()
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(text_of[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


_CODECS: dict[Vocabulary, Codec] = {}


def codec_of(shared) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    v = shared.value
    if v not in _CODECS:
        _CODECS.clear()
        _CODECS[v] = Codec(v)
    return _CODECS[v]


def shared_vocabulary(spark: SparkSession, model: str = MODEL):
    v = load_vocabulary(model)
    return broadcast_value(spark, v, v.n_bytes())


def slices(batch: pa.RecordBatch, column: str, max_chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a piece has about ``max_chars`` bytes of text: long texts don't add up in memory."""
    sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= max_chars:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def _run(shared, text: str, make: Callable[[Codec, list[str | None]], dict[str, pa.Array]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for whole in batches:
            for b in slices(whole, text):
                new = make(codec, b.column(text).to_pylist())
                keep = [n for n in b.schema.names if n not in new]
                yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + list(new.values()), keep + list(new))

    return run


def _schema(docs: DataFrame, new: str) -> str:
    names = {x.split()[0] for x in new.split(", ")}
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in names]
    return ", ".join([*keep, new])


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int) and ``n_pieces``; with ``check`` also ``round_trip``, whether decoding gives the text back."""

    def make(codec: Codec, texts: list[str | None]) -> dict[str, pa.Array]:
        ids = [None if t is None else codec.encode(t) for t in texts]
        out = {"ids": pa.array(ids, pa.list_(pa.int32())), "n_pieces": pa.array([len(x or ()) for x in ids], pa.int64())}
        if check:
            out["round_trip"] = pa.array([x is None or codec.decode(x) == t for t, x in zip(texts, ids)], pa.bool_())
        return out

    new = "ids array<int>, n_pieces bigint" + ", round_trip boolean" * check
    return docs.mapInArrow(_run(shared_vocabulary(docs.sparkSession, model), text, make), _schema(docs, new))


def decode(coded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` (null for null)."""
    shared = shared_vocabulary(coded.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(ids).to_pylist()]
            keep = [n for n in b.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    return coded.mapInArrow(run, _schema(coded, "decoded string"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "n_pieces", "ids", "round_trip")
