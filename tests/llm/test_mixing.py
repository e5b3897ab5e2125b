import re
from collections import defaultdict
from fractions import Fraction

from polyspark.llm import mixing as m


def share(children, budget):
    """Water filling over ``(name, cap, weight)``; whole tokens, rounded down."""
    left, out = sorted(children, key=lambda c: (Fraction(c[1], c[2]) if c[2] else Fraction(10**18), c[0])), {}
    while left:
        name, cap, weight = left[0]
        if weight and cap * sum(c[2] for c in left) <= budget * weight:
            out[name], budget = cap, budget - cap
            left.pop(0)
            continue
        total = sum(c[2] for c in left)
        out |= {c[0]: budget * c[2] // total if total else 0 for c in left}
        break
    return out


def test_against_brute_force(docs):
    got = m.mix(docs).collect()
    assert len(got) == docs.count()
    leaf = defaultdict(int)
    for r in got:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        leaf[r.domain, r.lang or "(null)", r.source or "(null)"] += r.n_tokens
    cap = lambda k: sum(4 * v for x, v in leaf.items() if x[: len(k)] == k)
    budgets = share([(d, cap((d,)), m.DOMAIN_WEIGHTS[d]) for d in {k[0] for k in leaf}], sum(leaf.values()))
    want = {}
    for d, b in budgets.items():
        for lang, c in share([(x, cap((d, x)), m.LANG_WEIGHTS.get(x, 1)) for x in {k[1] for k in leaf if k[0] == d}], b).items():
            for s, v in share([(x, cap((d, lang, x)), 1) for x in {k[2] for k in leaf if k[:2] == (d, lang)}], c).items():
                want[d, lang, s] = v
    taken = defaultdict(list)
    for r in got:
        k = (r.domain, r.lang or "(null)", r.source or "(null)")
        assert r.leaf_budget == want[k]
        taken[k].append(r)
    for k, rows in taken.items():
        used = sum(r.copies * r.n_tokens for r in rows)
        # the shortest prefix that reaches the budget: less than one document over it
        assert want[k] <= used < want[k] + max(1, max(r.n_tokens for r in rows))
        assert max(r.copies for r in rows if r.n_tokens or True) - min(r.copies for r in rows if r.n_tokens or len(rows) == 1) <= 1


def test_small_buckets_take_the_same(docs, monkeypatch):
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, r.copies) for r in df.select("doc_id", "n_tokens", "copies").collect())
    one = key(m.mix(docs))
    monkeypatch.setattr(m, "ROWS_PER_BUCKET", 2)
    assert key(m.mix(docs)) == one


def test_seed_and_budget(docs, none):
    a, b = (sorted((str(r.doc_id), r.copies) for r in m.mix(docs, budget=3000, seed=s).select("doc_id", "copies").collect()) for s in (1, 2))
    assert a != b and m.mix(none).count() == 0


def test_no_python_in_the_plan(docs):
    plan = m.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clashing_names_and_ties(spark):
    rows = [(None, "a b c", "en", "src1", 9, "x", 1.5)] * 3 + [(7, "a b", "en", "src2", 9, "x", 1.5)] * 2 + [(8, "a b", "en", "src1", 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, leaf_budget int, `__start` string, `__Epochs` double")
    got = m.mix(docs, budget=6)
    assert len(set(got.columns)) == len(got.columns) and {"__start", "__Epochs"} <= set(got.columns)
    found = got.collect()
    assert len(found) == 6
    # equal rows are taken together
    assert len({r.copies for r in found if r.doc_id is None}) == 1 and len({r.copies for r in found if r.doc_id == 7}) == 1


def test_many_leaves_take_the_same(docs, monkeypatch):
    key = lambda df: sorted((str(r.doc_id), r.n_tokens, r.copies) for r in df.select("doc_id", "n_tokens", "copies").collect())
    one = key(m.mix(docs))
    monkeypatch.setattr(m, "BROADCAST_LIMIT", -1)
    assert key(m.mix(docs)) == one
