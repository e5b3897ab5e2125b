"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed features of its whole words (their shape and their marks, and whether a word repeats the last one),
weighted by inverse document frequency over all documents, and projected on the leading directions of a
bounded sample of labelled texts. The sample's vectors are broadcast (at most ``MAX_LABELLED`` of ``DIMS`` numbers);
each document's cosine with every one of them is computed in blocks, exactly, and its ``NEIGHBOURS`` nearest vote
with their labels, weighted by a power of their similarity.

Cases: a null or empty text has no vector; its score is the share of label 1 in the sample. Rows without a
label, with a null label or with several different labels are not learned from. With no labelled row at all every
score is 0.5. Repeated rows get equal scores. A null doc_id is not held out. Labels, lang, source and doc_id are no
inputs of a score. Only the id and the text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm.common import broadcast_value
from polyspark.llm.sentencepiece_codec import slices

FEATURES = 1024
DIMS = 48
#: The bound on labelled rows that the model is fitted on.
MAX_LABELLED = 6000
NEIGHBOURS = 25
POWER = 8
CUT = 0.7
MEMO_WORDS = 300_000
BLOCK = 512

_SHAPE = ((re.compile(r"[A-ZÀ-ÖØ-Þ]"), "A"), (re.compile(r"[^\W\d_A]"), "a"), (re.compile(r"\d"), "9"), (re.compile(r"(.)\1+"), r"\1"))
_memo: dict[str, tuple[int, int]] = {}


def _slot(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % FEATURES


def _features_of(word: str) -> tuple[int, int]:
    """Hashed shape and hashed marks of one word."""
    s = word
    for pattern, to in _SHAPE:
        s = pattern.sub(to, s)
    marks = "".join(c for c in word if not c.isalnum())
    return _slot("s" + s), _slot(f"m{marks}:{min(len(word), 20) // 4}")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of a text."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct_words = Counter(words)
    out: list[int] = []
    get = _memo.get
    for w in distinct_words:
        f = get(w)
        if f is None:
            if len(_memo) >= MEMO_WORDS:
                _memo.clear()
            f = _features_of(w)
            # the memo stays small
            if len(w) <= 64:
                _memo[w] = f
        out += f
    times = np.repeat(np.fromiter(distinct_words.values(), np.int64, len(distinct_words)), 2)
    sums = np.bincount(np.array(out), times, FEATURES).astype(np.int64)
    at = np.flatnonzero(sums)
    n = sums[at]
    repeats = sum(map(str.__eq__, words, words[1:]))
    distinct = len(distinct_words) * 10 // len(words)
    extra = [_slot("repeat"), _slot(f"distinct{distinct}")]
    return np.concatenate([at, extra]), np.concatenate([n, [repeats, len(words) // 4 + 1]])


def _matrix(texts: list[str | None]) -> np.ndarray:
    x = np.zeros((len(texts), FEATURES), np.float32)
    for i, t in enumerate(texts):
        at, n = features(t)
        np.add.at(x[i], at, n)
    return x


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Shares of a text's features, square-rooted, times idf, with length one (zero for empty texts)."""
    x = np.sqrt(x / np.maximum(x.sum(axis=1, keepdims=True), 1)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents each feature occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                for t in b.column("text").to_pylist():
                    at, n = features(t)
                    df[np.unique(at[n > 0])] += 1
                    df[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(df)], ["f", "n"])

    sums = docs.select("text").mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(FEATURES + 1, np.int64)
    df[sums["f"].to_numpy()] = sums["n"].to_numpy()
    return df[:-1], int(df[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts and labels of up to ``bound`` labelled rows that are not held out, in the order of a hash of the id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).filter("y = z")
    # labels of rows that have no document take no place in the sample
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).select("doc_id", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                got = [features(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("y"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))],
                    ["doc_id", "y", "at", "n"],
                )

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"), "text")
    got = got.mapInArrow(run, "doc_id long, y int, at array<long>, n array<long>")
    # a repeated id is one row of the sample
    got = got.groupBy("doc_id").agg(F.min(F.struct("y", "at", "n")).alias("r")).select("doc_id", "r.*").orderBy("doc_id").toArrow().to_pandas()
    x = np.zeros((len(got), FEATURES), np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"])):
        np.add.at(x[i], np.asarray(at, np.int64), np.asarray(n, np.float32))
    return x, got["y"].to_numpy(np.float32)


def fit(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    x, y = labelled_sample(docs, labels)
    x = _weighted(x, idf)
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64)) if len(x) else (None, np.eye(FEATURES))
    axes = np.ascontiguousarray(vectors[:, ::-1][:, :DIMS], np.float32)
    z = x @ axes
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    return {"idf": idf, "axes": axes, "vectors": z, "labels": y, "prior": np.float32(y.mean() if len(y) else 0.5)}


def vote(texts: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    """Scores of a block of texts."""
    x = _weighted(_matrix(texts), model["idf"])
    out = np.full(len(texts), model["prior"], np.float64)
    full = np.flatnonzero(x.any(axis=1))
    if not len(full) or not len(model["labels"]):
        return out
    z = x[full].astype(np.float64) @ model["axes"].astype(np.float64)
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    # products may differ in the last bits with a text's place in the block: in steps of 1e-9 they don't
    cos = z @ model["vectors"].T.astype(np.float64)
    cos *= -1e9
    np.rint(cos, out=cos)
    k = min(NEIGHBOURS, cos.shape[1])
    near = np.argpartition(cos, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cos, near, axis=1) * -1e-9, 1e-6) ** POWER
    out[full] = (weight * model["labels"][near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict[str, np.ndarray], cut: float = CUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    shared = broadcast_value(docs.sparkSession, model, sum(v.nbytes for v in model.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text"):
                for start in range(0, part.num_rows, BLOCK):
                    b = part.slice(start, BLOCK)
                    s = vote(b.column("text").to_pylist(), shared.value)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
