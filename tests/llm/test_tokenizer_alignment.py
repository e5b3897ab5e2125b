import hashlib
import re
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from polyspark.llm import tokenizer_alignment as t

A = Tokenizer.from_file(t.MODEL_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=t.MODEL_B)
CODER = t.Coder(t.load_models())


def tokens(text: str | None):
    """Whole-text codes of both tokenizers as ``id, start, end``, or none."""
    if not text:
        return [], []
    whole, out = (" " + text).encode(), []
    for ids, parts in ((A.encode(" " + text, add_special_tokens=False).ids, CODER.bytes_a), (B.encode(text), CODER.bytes_b)):
        at, rows = 0, []
        for i in ids:
            rows.append((i, at, at + len(parts[i])))
            at += len(parts[i])
        if b"".join(parts[i] for i in ids) != whole:
            return [], []
        out.append(rows)
    return out


def aligned(text: str | None) -> tuple[str, list[tuple[int, int]], int, int, int]:
    a, b = tokens(text)
    cuts = sorted({x[2] for x in a} & {x[2] for x in b})
    groups, low = [], 0
    for cut in cuts:
        ids = lambda rows: ",".join(str(i) for i, s, e in rows if low <= s and e <= cut)  # noqa: B023, E731
        groups.append(f"{ids(a)}|{ids(b)}")
        low = cut
    links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
    return ";".join(groups), links, len(a), len(b), len(groups)


def brute(rows) -> list[tuple]:
    got = [(r.doc_id, *aligned(r.text)) for r in rows]
    count = Counter(p for x in got for p in set(x[2]))
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return sorted(((d, na, nb, ng, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), g) for d, g, links, na, nb, ng in got), key=repr)


def took(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select("doc_id", *t.NUMBERS, df.columns[-1]).collect()), key=repr)


AWKWARD = [
    "a  b", "a   b   ", "  lead", "trail ", " ", "   ", "\n  x\n y", "tab\t end", "nbsp  x", "em  x  y", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x0A>", "it's we'll 12345 3.14 !!! ??",
    "漢字 かな 한글 text", "🙂🙂 👩‍👩‍👧 é", "\x00 \x1c \x1f x\x1c y", "x\u0085 y", "Ａ ﬁ ™", "aaaa" * 50, "\r\n\r\n  \r\n a",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_units_code_as_the_whole(text):
    a, b = CODER.encode(t.units_of(text))
    assert [i for x in a for i in x] == A.encode(" " + text, add_special_tokens=False).ids
    assert [i for x in b for i in x] == B.encode(text)
    assert "".join(t.units_of(text)) == " " + text


def test_blocks_are_cut_between_units(monkeypatch):
    text = "a  bc d   ef\n g " * 40 + "x" * 100 + " end"
    whole = t.units_of(text)
    monkeypatch.setattr(t, "BLOCK_CHARS", 30)
    assert len([*t.blocks_of(text)]) > 5 and t.units_of(text) == whole


@pytest.fixture(scope="module")
def mixed(spark, texts):
    short = [x if x is None or len(x) < 3000 else x[:3000] for x in texts]
    rows = [(i, x, "z", 1) for i, x in enumerate([*short, *AWKWARD, *AWKWARD[:5]])] + [(None, "no id here", "z", 1), (None, None, "z", 1), (1, short[30], "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, `key` string, n_a int").repartition(3)


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_as_brute_force(spark, mixed, monkeypatch, hot):
    """Also with most pairs too rare for the broadcast."""
    monkeypatch.setattr(t, "HOT_PAIRS", hot)
    assert took(t.align(mixed)) == brute(mixed.collect())


def test_task_by_itself(mixed, monkeypatch):
    """Slices of a few texts, blocks of a few units and a memory that is soon full."""

    class Shared:
        value = t.load_models()

    for name, size in (("SLICE_BYTES", 2000), ("BLOCK_CHARS", 50), ("MEMO_UNITS", 300)):
        monkeypatch.setattr(t, name, size)
    t._UNITS.clear()
    rows = mixed.collect()
    batch = pa.RecordBatch.from_pydict({"key": pa.array([r.doc_id for r in rows]), "text": pa.array([r.text for r in rows])})
    got = [r for b in t._align(Shared, False)(iter([batch])) for r in b.to_pylist()]
    for r, x in zip(rows, got):
        groups, links, n_a, n_b, n_groups = aligned(r.text)
        assert (x["groups"], x["n_a"], x["n_b"], x["n_groups"], x["n_links"]) == (groups, n_a, n_b, n_groups, len(links))
        assert dict(zip(x["pairs"], x["times"])) == Counter((a << 32) + b for a, b in links)


def test_query(spark):
    at = "/root/testdata/sf0.001"
    want = [(*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in brute(spark.read.parquet(f"{at}/documents.parquet").collect())]
    assert took(t.query(spark, at)) == sorted(want, key=repr)


def test_long_text(spark):
    """Each link of a long text counts; a unit without any space is long as well."""
    text = "word and again " * 60_000 + "x" * 20_000
    (r,) = t.align(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    assert (r.n_a, r.n_b) == (len(a), len(b)) and r.n_links == r.count_sum == len(a) + len(b) - r.n_groups
    assert re.sub(r"[|;,]+", " ", r.groups).split().__len__() == len(a) + len(b)


def test_pair_counts(spark, mixed):
    want = Counter(p for r in mixed.collect() for p in set(aligned(r.text)[1]))
    assert {(r.a, r.b): r.n for r in t.pair_counts(mixed).collect()} == dict(want)


def test_empty_table(none):
    assert t.align(none).count() == 0
