"""Personal data by a skip-chain conditional random field.

Patterns with checks give base spans. The field labels every token that has a digit or ``@`` (all others are clamped to
"none"): neighbouring tokens are linked as a chain, and distant tokens that repeat or have the same digits are linked
as skip edges, consecutive ones in a document, so links grow with the tokens. Loopy message passing, until it settles, gives each token's
label probabilities; tokens in base spans are clamped to their kind, so that what is found once holds
for its repeats. Weights are trained on a bounded sample (``TRAIN_DOCS`` documents, ``TRAIN_TOKENS`` tokens): the
token weights by logistic regression on base labels, the edge weights from label pairs (piecewise training). Tokens above
``MIN_PROBABILITY`` add spans where no base span is.

Cases: a null text counts as empty: no spans. Very long texts are labelled whole; all patterns run in linear time.
Repeated rows are judged one by one. An empty table trains a field that adds nothing. Other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyspark.llm.common import broadcast_value
from polyspark.llm.sentencepiece_codec import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
TRAIN_DOCS = 20_000
TRAIN_TOKENS = 100_000
MIN_PROBABILITY = 0.95
DAMPING = 0.5
#: Message changes under this are none.
TOLERANCE = 1e-5
CLAMP = 20.0
MIN_DIGITS_ALIKE = 6

# The contract's patterns, written so that none tries a run of characters twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_TOKENS = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(r"[\x20\x09-\x0D]*")
_EDGE = ".,;:!?()[]{}\"'<>"

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Checked matches of the four patterns, by kind and start."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Whitespace tokens that have a digit or ``@``."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    out, at = [], 0
    for m in re.finditer("[0-9@]", text):
        if m.start() < at:
            continue
        start = m.start()
        while start > at and text[start - 1] not in " \t\n\x0b\x0c\r":
            start -= 1
        at = _TOKENS.match(text, m.start()).end()
        out.append((start, at))
    return out


def _word_before(text: str, start: int) -> str:
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    at = end
    while at and not text[at - 1].isspace():
        at -= 1
    return re.sub(r"[\W\d_]+", "", text[at:end]).lower()


N_CUES = 16
N_FEATURES = 26 + N_CUES


def token_features(text: str, start: int, end: int) -> list[float]:
    t = text[start:end]
    digits = re.sub("[^0-9]", "", t)
    n, dots = len(digits), t.count(".")
    letters = sum(c.isalpha() for c in t)
    core = t.strip(_EDGE)
    head, _, domain = core.partition("@")
    octets = core.split(".")
    like_ip = len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets)
    cue = hashlib.md5(_word_before(text, start).encode("utf-8", "surrogatepass")).digest()[0] % N_CUES
    flags = [
        True, n == 0, n == 1, n == 2, 3 <= n <= 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19,
        "@" in core, bool(head and "." in domain), dots == 1, dots == 3, dots > 3, t.startswith("+"), "(" in t and ")" in t,
        "-" in core, letters == 0, 1 <= letters <= 3, letters > 3, like_ip, 13 <= n <= 19 and _luhn(digits),
        core.isdigit(), "/" in t, "=" in t or '"' in t, end - start > 40,
    ]
    return [float(x) for x in flags] + [float(k == cue) for k in range(N_CUES)]


def _alike(text: str, start: int, end: int) -> str:
    t = text[start:end]
    digits = re.sub("[^0-9]", "", t)
    return digits if len(digits) >= MIN_DIGITS_ALIKE else t.strip(_EDGE).lower()


def graph(text: str, toks: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between tokens with only white space between, and skip edges between consecutive alike tokens."""
    chain = [(k, k + 1) for k in range(len(toks) - 1) if _GAP.match(text, toks[k][1], toks[k + 1][0]).end() == toks[k + 1][0]]
    skip, last = [], {}
    for k, (s, e) in enumerate(toks):
        key = _alike(text, s, e)
        if key in last:
            skip.append((last[key], k))
        last[key] = k
    return chain, skip


def token_labels(toks: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The kind of the base span over each token (0: none); the first kind as listed where several are."""
    out = [0] * len(toks)
    if not spans:
        return out
    starts = np.array([s for s, _ in toks])
    ends = np.array([e for _, e in toks])
    for kind, s, e in reversed(spans):
        for k in range(int(np.searchsorted(ends, s, "right")), int(np.searchsorted(starts, e, "left"))):
            out[k] = LABELS.index(kind)
    return out


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities by loopy sum-product in log space, until no message changes. ``edges``: rows of (u, v, type); ``potentials[type]`` is L x L."""
    if not len(edges):
        b = unary
    else:
        u = np.concatenate([edges[:, 0], edges[:, 1]])
        v = np.concatenate([edges[:, 1], edges[:, 0]])
        p = np.concatenate([potentials[edges[:, 2]], potentials[edges[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        m = np.zeros((len(u), unary.shape[1]))
        by_u = np.argsort(u, kind="stable")
        start = np.searchsorted(u[by_u], np.arange(len(unary) + 1))
        b, todo, times = unary.copy(), np.arange(len(u)), np.zeros(len(u), np.int64)
        # a message that still swings long after all could have reached it is damped more and more
        patience = 200 + 4 * len(unary)
        while len(todo):
            s = (b[u[todo]] - m[back[todo]])[:, :, None] + p[todo]
            top = s.max(axis=1, keepdims=True)
            new = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = (new - m[todo]) * ((1 - DAMPING) * 0.97 ** np.maximum(0, times[todo] - patience))[:, None]
            moved = np.abs(change).max(axis=1) > TOLERANCE
            todo, change = todo[moved], change[moved]
            m[todo] += change
            times[todo] += 1
            np.add.at(b, v[todo], change)
            # next: these again, and the messages out of the tokens they reached
            to = np.unique(v[todo])
            size = start[to + 1] - start[to]
            out = by_u[np.repeat(start[to] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            todo = np.unique(np.concatenate([todo, out]))
        b = unary.copy()
        np.add.at(b, v, m)
    b = np.exp(b - b.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


def fit_field(x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> dict[str, np.ndarray]:
    """Token weights by softmax regression; edge weights as smoothed log ratios of label pairs."""
    n_labels = len(LABELS)
    w = np.zeros((N_FEATURES, n_labels))
    if len(x):
        target = np.eye(n_labels)[y]
        rate = 4.0 / max(1.0, np.linalg.norm(x, axis=1).mean() ** 2)
        for _ in range(300):
            s = x @ w
            s = np.exp(s - s.max(axis=1, keepdims=True))
            w -= rate * (x.T @ (s / s.sum(axis=1, keepdims=True) - target) / len(x) + 1e-5 * w)
    else:
        w[0, 0] = 10.0

    def ratios(pairs: np.ndarray, diagonal: float) -> np.ndarray:
        c = pairs + pairs.T + 0.5 + diagonal * np.eye(n_labels)
        return np.log(c * c.sum() / np.outer(c.sum(axis=1), c.sum(axis=0)))

    return {"weights": w, "potentials": np.stack([ratios(chain, 0.0), ratios(skip, 5.0)])}


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Trains on whole documents: about ``TRAIN_DOCS`` by a hash of id and text, in its order while they fit ``TRAIN_TOKENS``.

    A document that no longer fits is passed over. Equal rows count once. The choice depends on the rows alone, not on
    their order or partitions.
    """
    spark = docs.sparkSession
    # in parts of 10 ** 18, so that the share of a table of any size is above zero
    share = int(min(1.0, TRAIN_DOCS / max(1, docs.count())) * 10**18)
    place = F.xxhash64("doc_id", "text", F.lit(len(LABELS)))
    part = F.pmod(place, F.lit(10**6)) * F.lit(10**12) + F.pmod(F.shiftright(place, 20), F.lit(10**12))
    sample = docs.filter(part < share).select(place.alias("place"), "text")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(tokens(t or "")) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("place"), n], ["place", "n"])

    # one narrow row for each of about TRAIN_DOCS documents
    size = sample.mapInArrow(sizes, "place long, n long").filter("n > 0").groupBy("place").agg(F.max("n").alias("n"))
    chosen, total = [], 0
    for r in sorted(size.toArrow().to_pylist(), key=lambda r: r["place"]):
        if total + r["n"] <= TRAIN_TOKENS:
            chosen.append((r["place"],))
            total += r["n"]
    fitting = F.broadcast(spark.createDataFrame(chosen, "place long"))
    sample = sample.join(fitting, "place", "left_semi").groupBy("place").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                toks = tokens(text or "")
                y = token_labels(toks, base_spans(text)) if toks else []
                chain, skip = graph(text, toks) if toks else ([], [])
                after, alike = dict(chain), dict(skip)
                for k, (s, e) in enumerate(toks):
                    rows.append((y[k], y[after[k]] if k in after else -1, y[alike[k]] if k in alike else -1, token_features(text, s, e)))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.list_(pa.float32()))], ["y", "after", "alike", "x"])

    got = sample.mapInArrow(run, "y int, after int, alike int, x array<float>").toArrow().to_pandas()
    got = got.sort_values(["y", "after", "alike"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), N_FEATURES)
    # the order of rows may differ between runs, so sums are taken over sorted rows
    order = np.lexsort(np.column_stack([x, got[["y", "after", "alike"]].to_numpy()]).T) if len(got) else []
    y, after, alike = (got[c].to_numpy()[order].astype(np.int64) if len(got) else np.zeros(0, np.int64) for c in ("y", "after", "alike"))
    pairs = []
    for other in (after, alike):
        c = np.zeros((len(LABELS), len(LABELS)))
        np.add.at(c, (y[other >= 0], other[other >= 0]), 1)
        pairs.append(c)
    return fit_field(x[order] if len(got) else x, y, *pairs)


def find_spans(texts: list[str | None], model: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text; the field runs over all texts of the block at once."""
    base, toks, unary, edges, first = [], [], [], [], []
    n = 0
    for text in texts:
        spans = base_spans(text) if text else []
        own = tokens(text) if text else []
        base.append(spans)
        toks.append(own)
        first.append(n)
        if own:
            u = np.array([token_features(text, s, e) for s, e in own]) @ model["weights"]
            y = np.array(token_labels(own, spans))
            u[y > 0] = 0.0
            u[np.flatnonzero(y), y[y > 0]] = CLAMP
            unary.append(u)
            for kind, pairs in enumerate(graph(text, own)):
                edges += [(n + a, n + b, kind) for a, b in pairs]
        n += len(own)
    if not n:
        return [(b, []) for b in base]
    prob = marginals(np.concatenate(unary), np.array(edges, np.int64).reshape(-1, 3), model["potentials"])
    label, sure = prob.argmax(axis=1), prob.max(axis=1) >= MIN_PROBABILITY
    out = []
    for text, spans, own, at in zip(texts, base, toks, first):
        added: list[Span] = []
        taken = sorted((s, e) for _, s, e in spans)
        before = 0
        for k, (s, e) in enumerate(own):
            kind = LABELS[label[at + k]] if sure[at + k] else "none"
            while before < len(taken) and taken[before][1] <= s:
                before += 1
            if kind == "none" or before < len(taken) and taken[before][0] < e:
                continue
            s += len(text[s:e]) - len(text[s:e].lstrip(_EDGE))
            e -= len(text[s:e]) - len(text[s:e].rstrip(_EDGE))
            if e <= s:
                continue
            if added and added[-1][0] == kind and k and added[-1][2] <= own[k - 1][1] and added[-1][2] > own[k - 1][0] and _GAP.match(text, own[k - 1][1], own[k][0]).end() == own[k][0]:
                added[-1] = (kind, added[-1][1], e)
            else:
                added.append((kind, s, e))
        out.append((spans, added))
    return out


_SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def _in_order(base: list[Span], added: list[Span]) -> list[dict]:
    rows = [(KINDS.index(k), s, e, True) for k, s, e in base] + [(KINDS.index(k), s, e, False) for k, s, e in added]
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in sorted(rows)]


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    out, done, end, mark = [], 0, -1, ""
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] < end:
            end = max(end, s["end"])
            continue
        if end >= 0:
            out.append(mark)
            done = end
        out.append(text[done : s["start"]])
        end, mark = s["end"], f"<{s['kind'].upper()}>"
    return text if end < 0 else "".join([*out, mark, text[end:]])


def annotate(docs: DataFrame, model: dict[str, np.ndarray], redact: bool = False) -> DataFrame:
    """Adds ``spans``; with ``redact`` the text is replaced too."""
    shared = broadcast_value(docs.sparkSession, model, sum(v.nbytes for v in model.values()))
    keep = [f for f in docs.schema.fields if f.name != "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                spans = [_in_order(*x) for x in find_spans(texts, shared.value)]
                cols = {f.name: b.column(f.name) for f in keep}
                if redact:
                    cols["text"] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)], pa.string())
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(spans, _ARROW)], [*cols, "spans"])

    schema = T.StructType(keep + [T.StructField("spans", T._parse_datatype_string(_SPANS))])
    return docs.select([f.name for f in keep]).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = annotate(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
