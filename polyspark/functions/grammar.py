"""The grammar of token sequences as a finite automaton: which ids may follow a prefix.

A token is one of a few kinds, and each kind is a map from states to states. Maps compose and composition is associative, so the map of
a sequence is the composition of the maps of its parts, however it is cut: parts can be folded apart and combined. A state also
tells whether the line has enough points; a token that does not fit leads to a state of failure that remembers where.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyspark.functions import tokens
from polyspark.functions.tokens import Vocabulary

KINDS = ("line", "category", "type", "start", "end", "pts", "x", "y", "eol", "other")
BETWEEN, AFTER_LINE, AFTER_CATEGORY, AFTER_TYPE, AFTER_START, AFTER_END, WANT_X = range(7)


@dataclass(frozen=True)
class Grammar:
    """States are the seven without points, then "wants y" with 0 to ``min_points`` points done and "has a point" with 1 to
    ``min_points``; state ``n_live + s`` is failure in state ``s``."""

    v: Vocabulary = Vocabulary()
    min_points: int = 2

    @property
    def least(self) -> int:
        return max(1, self.min_points)

    def want_y(self, done: int) -> int:
        return WANT_X + 1 + done

    def point(self, done: int) -> int:
        return self.want_y(self.least) + min(done, self.least)

    @property
    def n_live(self) -> int:
        return self.point(self.least) + 1

    @cached_property
    def moves(self) -> dict[tuple[int, str], int]:
        """What fits: state and kind to the next state."""
        out = {(BETWEEN, "line"): AFTER_LINE, (AFTER_LINE, "category"): AFTER_CATEGORY, (AFTER_CATEGORY, "start"): AFTER_START, (AFTER_TYPE, "start"): AFTER_START}
        out |= {(AFTER_START, "end"): AFTER_END, (AFTER_END, "pts"): WANT_X, (WANT_X, "x"): self.want_y(0), (self.point(self.least), "eol"): BETWEEN}
        if self.v.line_types:
            out[AFTER_CATEGORY, "type"] = AFTER_TYPE
        for done in range(self.least + 1):
            out[self.want_y(done), "y"] = self.point(done + 1)
            if done:
                out[self.point(done), "x"] = self.want_y(done)
        return out

    @cached_property
    def table(self) -> list[int]:
        """The next state of (state, kind), kinds side by side, for live states."""
        return [self.moves.get((s, k), self.n_live + s) for s in range(self.n_live) for k in KINDS]

    @cached_property
    def ranges(self) -> dict[str, tuple[int, int]]:
        """First and last id of each kind."""
        v = self.v
        one = lambda i: (i, i)
        return {
            "line": one(tokens.LINE), "category": (len(tokens.SPECIALS), v.first_type - 1), "type": (v.first_type, v.first_start - 1), "start": (v.first_start, v.first_start + 1),
            "end": (v.first_start + 2, v.first_start + 3), "pts": one(tokens.PTS), "x": (v.first_x, v.first_y - 1), "y": (v.first_y, v.first_angle - 1), "eol": one(tokens.EOL),
        }

    def kind(self, id_: Column) -> Column:
        """The number of an id's kind."""
        out = F.when(F.lit(False), F.lit(0))
        for name, (low, high) in self.ranges.items():
            if low <= high:
                out = out.when(id_.between(low, high), F.lit(KINDS.index(name)))
        return out.otherwise(F.lit(len(KINDS) - 1))

    def allowed(self, state: int, full: bool = False) -> list[tuple[int, int]]:
        """The ranges of ids that may follow a state; ``full``: there are as many lines as may be."""
        at = state % self.n_live
        if at == BETWEEN:
            end = (tokens.EOS, tokens.EOS)
            return [end] if full and state == at else [self.ranges["line"], end]
        return [self.ranges[k] for k in ("x", "y", "category", "type", "start", "end", "pts", "eol") if (at, k) in self.moves]


def _table(g: Grammar) -> Column:
    return F.array(*map(F.lit, g.table))


def step(g: Grammar, state: Column, id_: Column) -> Column:
    """The state after one more id."""
    return F.when(state >= g.n_live, state).otherwise(F.get(_table(g), state * len(KINDS) + g.kind(id_)))


def map_of(g: Grammar, ids: Column) -> Column:
    """The map of a part of a sequence: where each live state ends."""
    return F.transform(F.sequence(F.lit(0), F.lit(g.n_live - 1)), lambda s: F.aggregate(ids, s, lambda at, i: step(g, at, i)))


def compose(g: Grammar, first: Column, then: Column) -> Column:
    """The map of two parts, one after the other."""
    return F.transform(first, lambda s: F.when(s >= g.n_live, s).otherwise(F.get(then, s)))


def state_of(g: Grammar, ids: Column) -> Column:
    """The state after the first id."""
    return F.aggregate(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.lit(BETWEEN), lambda at, i: step(g, at, i))


def valid_next(g: Grammar, state: Column, started: Column, ended: Column, empty: Column, n_lines: Column, max_lines: int | None = None) -> Column:
    """Ranges ``first, last`` of ids that may follow a prefix in ``state``.

    An empty prefix, or one that does not begin with the begin mark (``started``), wants that mark; one with the end mark anywhere (``ended``) wants it again.
    """
    span = lambda rows: F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last")) for a, b in rows])
    # one entry for each live state, each failure, and the full map at last
    every = F.array(*[span(g.allowed(s)) for s in range(2 * g.n_live)], span(g.allowed(BETWEEN, True)))
    full = F.lit(False) if max_lines is None else (state == BETWEEN) & (n_lines >= max(1, max_lines))
    at = F.get(every, F.when(full, F.lit(2 * g.n_live)).otherwise(state))
    return F.when(empty, span([(tokens.BOS, tokens.BOS)])).when(ended, span([(tokens.EOS, tokens.EOS)])).when(~started, span([(tokens.BOS, tokens.BOS)])).otherwise(at)


def valid_after(g: Grammar, ids: Column, max_lines: int | None = None) -> Column:
    """``valid_next`` of a whole array of ids."""
    n_lines = F.size(F.filter(ids, lambda i: i == tokens.EOL))
    return valid_next(g, state_of(g, ids), F.coalesce(F.get(ids, F.lit(0)) == tokens.BOS, F.lit(False)), F.array_contains(ids, tokens.EOS), F.size(ids) == 0, n_lines, max_lines)


def prefixes(rows: DataFrame, g: Grammar, key: str = "token", ids: str = "ids", part: int = 64, max_lines: int | None = None) -> DataFrame:
    """``key, n, allowed`` for every prefix of every sequence (``n`` ids long, none included).

    Sequences are cut into parts; the map of each part and the composition of the maps before it give the state in which a
    part begins, so parts of one sequence run in different tasks and each is walked once.
    """
    body = F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))
    starts = F.sequence(F.lit(0), F.greatest(F.size(body) - 1, F.lit(0)), F.lit(part))
    parts = rows.select(key, F.posexplode(F.transform(starts, lambda s: F.slice(body, s + 1, F.lit(part)))).alias("part", "chunk"))
    parts = parts.withColumn("map", map_of(g, F.col("chunk")))
    identity = F.sequence(F.lit(0), F.lit(g.n_live - 1))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    maps = F.collect_list("map").over(before)
    begin = F.get(F.aggregate(maps, identity, lambda a, b: compose(g, a, b)), F.lit(BETWEEN))
    # the states after each id of a part, from the one in which it begins
    walk = F.aggregate("chunk", F.array("begin"), lambda s, i: F.array_append(s, step(g, F.element_at(s, -1), i)))
    states = parts.withColumn("begin", begin).select(key, "part", "chunk", F.slice(walk, F.lit(2), F.size("chunk")).alias("states"))
    zipped = F.arrays_zip(F.col("chunk").alias("id"), F.col("states").alias("state"))
    inner = states.select(key, "part", F.posexplode(zipped).alias("at", "z")).select(key, (F.col("part") * part + F.col("at") + 2).alias("n"), "z.id", "z.state")
    first = rows.filter(F.size(ids) > 0).select(key, F.lit(1).alias("n"), F.get(ids, F.lit(0)).alias("id"), F.lit(BETWEEN).alias("state"))
    none = rows.select(key, F.lit(0).alias("n"), F.lit(None).cast("int").alias("id"), F.lit(BETWEEN).alias("state"))
    every = none.unionByName(first).unionByName(inner)
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.coalesce(F.max(c).over(upto), F.lit(False))
    every = every.withColumns({
        "started": flag((F.col("n") == 1) & (F.col("id") == tokens.BOS)), "ended": flag(F.col("id") == tokens.EOS), "lines": F.sum((F.col("id") == tokens.EOL).cast("int")).over(upto),
    })
    allowed = valid_next(g, F.col("state"), F.col("started"), F.col("ended"), F.col("n") == 0, F.coalesce("lines", F.lit(0)), max_lines)
    return every.select(key, "n", allowed.alias("allowed"))
