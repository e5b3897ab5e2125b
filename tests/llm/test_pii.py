import hashlib
import re

from polyspark.llm import pii


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


def texts_of(extra=()):
    return [*extra, "a@b.c.d@e.f x@y.z..w 1.2.3.4.5.6.7.8.9 1.1.1 0001.2.3.4 256.1.1.1", "🙂 +1234567890 +12 (34) 56-78.90 4111-1111-1111-1111 ++49 151 2345678", "x" * 300 + "@" + "1.2.3.4", "1" * 50, "@" * 40 + "a@b.co"]


def test_base_spans(texts):
    for t in texts_of(texts):
        assert pii.base_spans(t or "") == brute(t)


def test_query(spark, tmp_path, texts):
    rows = [(i, t) for i, t in enumerate(texts_of(texts))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pii.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        spans = got[i].spans.split(",") if got[i].spans else []
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(spans)


def test_repeated_and_similar_tokens_are_linked():
    t = "reach jo@example.org today. later write JO@EXAMPLE.ORG. or (jo@example.org)"
    chain, skip = pii.graph(t, pii.tokens(t))
    assert len(skip) == 2


def test_messages_carry_a_label_over_a_skip_link():
    import numpy as np

    unary = np.zeros((2, 5))
    unary[0, 3] = pii.CLAMP
    unary[1, 0] = 0.5
    same = np.log(np.eye(5) * 50 + 1)
    p = pii.marginals(unary, np.array([[0, 1, 1]]), np.stack([np.zeros((5, 5)), same]))
    assert p[1].argmax() == 3
    alone = pii.marginals(unary, np.zeros((0, 3), int), np.stack([same, same]))
    assert alone[1].argmax() == 0


def test_one_base_match_reaches_fifty_variants():
    import numpy as np

    text = "call +4930123456 then " + " and ".join(["49-301-23456", "(49)30123456"] * 25) + " end"
    weights = np.zeros((pii.N_FEATURES, len(pii.LABELS)))
    potentials = np.stack([np.zeros((5, 5)), np.eye(5) * 10.0])
    [(base, added)] = pii.find_spans([text], {"weights": weights, "potentials": potentials})
    assert [k for k, _, _ in base] == ["phone"]
    assert len(added) == 50 and {k for k, _, _ in added} == {"phone"}


def test_redaction_and_cases(docs, none):
    assert pii.annotate(none, pii.fit(none)).count() == 0
    out = pii.annotate(docs, pii.fit(docs), redact=True)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert len(rows) == docs.count() and all(not brute(r.text) for r in rows if r.text)
    assert pii.redacted("ab 12 cd", [{"kind": "card", "start": 3, "end": 5}]) == "ab <CARD> cd"


def test_training_is_the_same_however_the_rows_lie(spark, texts):
    import numpy as np

    rows = [(i, t) for i, t in enumerate(texts_of(texts))] + [(900, "call +49 30 12345678 " * 3000)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = pii.fit(docs.repartition(1)), pii.fit(docs.repartition(7))
    assert all(np.allclose(a[k], b[k]) for k in a)


def test_word_before_is_whole():
    t = "x" * 500 + "Phone: 12"
    assert pii._word_before(t, t.index("12")) == "x" * 500 + "phone"
