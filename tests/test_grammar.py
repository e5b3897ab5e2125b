"""The automaton against a walk from token to token."""

import random

import pytest
from pyspark.sql import functions as F

from polyspark.functions import grammar as gr
from polyspark.functions import tokens as t

V = t.Vocabulary(bins=4, angles=3, size=4)
BARE = t.Vocabulary(line_types=(), bins=4, angles=3, size=4)


def walk(ids, v, least, most):
    """Allowed ids after ``ids``, by hand."""
    cats, kinds = range(10, v.first_type), range(v.first_type, v.first_start)
    starts, ends = range(v.first_start, v.first_start + 2), range(v.first_start + 2, v.first_x)
    xs, ys = range(v.first_x, v.first_y), range(v.first_y, v.first_angle)
    if ids and t.EOS in ids:
        return {t.EOS}
    if not ids or ids[0] != t.BOS:
        return {t.BOS}
    want, pairs, lines = {"line", "eos"}, 0, 0
    sets = {"line": {t.LINE}, "eos": {t.EOS}, "cat": set(cats), "type": set(kinds), "start": set(starts), "end": set(ends), "pts": {t.PTS}, "x": set(xs), "y": set(ys), "eol": {t.EOL}}
    after = {"line": {"cat"}, "cat": {"type", "start"}, "type": {"start"}, "start": {"end"}, "end": {"pts"}, "pts": {"x"}, "x": {"y"}}
    for i in ids[1:]:
        got = next((w for w in want if i in sets[w]), None)
        if got is None:
            return set().union(*(sets[w] for w in want))
        pairs = pairs + 1 if got == "y" else 0 if got == "pts" else pairs
        lines += got == "eol"
        want = {"x", "eol"} if got == "y" and pairs >= least else {"x"} if got == "y" else {"line", "eos"} if got == "eol" else after[got]
    if want == {"line", "eos"} and most is not None and lines >= most:
        return {t.EOS}
    return set().union(*(sets[w] for w in want))


def sequences(v, n=120):
    rng = random.Random(1)
    pick = lambda r: rng.choice(list(r))
    out = [[], [t.EOS], [t.LINE], [t.BOS], [t.BOS, t.EOS], [t.BOS, t.LINE, t.EOS, t.LINE]]
    for _ in range(n):
        ids = [t.BOS]
        for _ in range(rng.randint(0, 4)):
            ids += [t.LINE, pick(range(10, v.first_type))]
            if v.line_types and rng.random() < 0.5:
                ids.append(pick(range(v.first_type, v.first_start)))
            ids += [v.first_start + rng.randint(0, 1), v.first_start + 2 + rng.randint(0, 1), t.PTS]
            for _ in range(rng.randint(0, 5)):
                ids += [pick(range(v.first_x, v.first_y)), pick(range(v.first_y, v.first_angle))]
            ids.append(t.EOL)
        if rng.random() < 0.6:
            ids[rng.randrange(len(ids))] = rng.randrange(-1, v.n + 2)
        out.append(ids + [t.EOS] * (rng.random() < 0.3))
    return out


@pytest.mark.parametrize("v,least,most,part", [(V, 2, None, 64), (V, 3, 2, 5), (BARE, 1, 1, 7)])
def test_every_prefix(spark, v, least, most, part):
    seqs = sequences(v)
    g = gr.Grammar(v, least)
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "token int, ids array<int>")
    got = {(r.token, r.n): {i for x in r.allowed for i in range(x.first, x.last + 1)} for r in gr.prefixes(rows, g, part=part, max_lines=most).collect()}
    want = {(k, n): walk(s[:n], v, least, most) for k, s in enumerate(seqs) for n in range(len(s) + 1)}
    assert got == want
    whole = {r.token: {i for x in r.allowed for i in range(x.first, x.last + 1)} for r in rows.select("token", gr.valid_after(g, F.col("ids"), most).alias("allowed")).collect()}
    assert whole == {k: want[k, len(s)] for k, s in enumerate(seqs)}


def test_parts_combine_however_they_are_cut(spark):
    """Composition is associative: maps of parts combine to the map of the whole."""
    g = gr.Grammar(V, 2)
    seqs = [s for s in sequences(V, 40) if len(s) > 6]
    rows = spark.createDataFrame([(s, s[: k % 5], s[k % 5 : k % 5 + 3], s[k % 5 + 3 :]) for k, s in enumerate(seqs)], "w array<int>, a array<int>, b array<int>, c array<int>")
    m = lambda c: gr.map_of(g, F.col(c))
    rows = rows.select(m("w").alias("w"), m("a").alias("a"), m("b").alias("b"), m("c").alias("c"))
    join = lambda a, b: gr.compose(g, a, b)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    out = rows.select("w", join(join(a, b), c).alias("left"), join(a, join(b, c)).alias("right")).collect()
    assert all(r.w == r.left == r.right for r in out)
