from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `h` string, `kept` int, `spans` string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def make_texts() -> list[str | None]:
    """Nulls, empty and long texts, copies, near copies, shared passages and awkward characters."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(40, 160)) for _ in range(30)]
    passage = words(rng, 60)
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    return [
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        "Three Words Here",
        "tab\tand\x0bvertical\x0cfeed\r\nline no-break em",
        "ünïcödé 🙂🙂 ▁mark ▁ ▁▁ Ａ",
        " leading and trailing  double ",
        "same line here\nsame line here\n\nSHOUT SHOUT SHOUT SHOUT\n#### $$$$ %%%%",
        "menu | home | about | contact | help\n" + words(rng, 80) + "\nall rights reserved by us",
        words(rng, 6000),
        "a b c " * 400,
        *base,
        *base[:5],
        *near,
        *[words(rng, 30) + " " + passage + " " + words(rng, 30) for _ in range(6)],
        "write to jo.do+x@mail.example.org or jo.do+x@mail.example.org, ip 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111 "
        "and 4111111111111112, call +49 (30) 1234-5678 or +1 2",
        "call +49 30 12345678 or (49) 30 12345678. again 49 30 12345678 1.2.3.4.5.6.7.8 a@b@c.de @x.y a@b",
    ]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Awkward documents, with null and repeated ids, null groups and extra columns whose names clash."""
    rows = [(i, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"src{i % 4}", 1, "x", 2, "y") for i, t in enumerate(texts)]
    rows += [(3, rows[20][1], "en", "src1", 1, "x", 2, "y"), rows[20], (None, rows[21][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def components(n: int, edges) -> list[int]:
    """The root of each of ``n`` nodes: the smallest index reachable."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
