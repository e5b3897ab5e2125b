"""Map lines as integer token sequences. Ids are in closed form: no table is joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyspark.functions.text import CATEGORIES, LINE_TYPES

# The special tokens in id order.
SPECIALS = ("<pad>", "<bos>", "<eos>", "<state>", "<txt_xy>", "<txt_trace>", "<txt_end>", "<line>", "<pts>", "<eol>")
PAD, BOS, EOS, STATE, TEXT_XY, TRACE, TEXT_END, LINE, PTS, EOL = range(10)


@dataclass(frozen=True)
class Vocabulary:
    categories: tuple[str, ...] = CATEGORIES
    line_types: tuple[str, ...] = LINE_TYPES
    bins: int = 224
    angles: int = 360
    size: int = 224

    @property
    def first_type(self) -> int:
        return len(SPECIALS) + len(self.categories)

    @property
    def first_start(self) -> int:
        return self.first_type + len(self.line_types)

    @property
    def first_x(self) -> int:
        return self.first_start + 4

    @property
    def first_y(self) -> int:
        return self.first_x + self.bins

    @property
    def first_angle(self) -> int:
        return self.first_y + self.bins

    @property
    def n(self) -> int:
        return self.first_angle + self.angles

    def named(self) -> list[str]:
        return [*SPECIALS, *(f"<cat_{c}>" for c in self.categories), *(f"<lt_{t}>" for t in self.line_types), "<s_start>", "<s_cut>", "<e_end>", "<e_cut>"]


def table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    """``id, token`` of the whole vocabulary."""
    named = F.array(*map(F.lit, v.named()))
    i = F.col("id")
    token = (
        F.when(i < v.first_x, F.get(named, i.cast("int")))
        .when(i < v.first_y, F.concat(F.lit("<x_"), i - v.first_x, F.lit(">")))
        .when(i < v.first_angle, F.concat(F.lit("<y_"), i - v.first_y, F.lit(">")))
        .otherwise(F.concat(F.lit("<a_"), i - v.first_angle, F.lit(">")))
    )
    return spark.range(v.n).select(i.cast("int").alias("id"), token.alias("token"))


def quantize(value: Column, v: Vocabulary) -> Column:
    """The bin of a pixel coordinate, half to even."""
    return F.least(F.greatest(F.rint(value * (v.bins - 1) / (v.size - 1)).cast("int"), F.lit(0)), F.lit(v.bins - 1))


def dequantize(bin_: Column, v: Vocabulary) -> Column:
    return bin_ * (v.size - 1) / F.lit(float(v.bins - 1))


def quantize_angle(degrees: Column, v: Vocabulary) -> Column:
    return F.rint(F.pmod(degrees, F.lit(360.0)) * (v.angles - 1) / 360.0).cast("int")


def line_ids(line: Column, v: Vocabulary) -> Column:
    """``<line>`` category [type] start end ``<pts>`` (x y)* ``<eol>`` of a struct with the fields of a line."""
    number = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c).cast("int")
    kind = number(v.line_types, line["line_type"])
    head = F.concat(
        F.array(F.lit(LINE), number(v.categories, line["category"]) - 1 + len(SPECIALS)),
        F.when(kind > 0, F.array(kind - 1 + v.first_type)).otherwise(F.array().cast("array<int>")),
        F.array((line["start_type"] == "cut").cast("int") + v.first_start, (line["end_type"] == "cut").cast("int") + v.first_start + 2, F.lit(PTS)),
    )
    pairs = F.flatten(F.transform(line["points"], lambda p: F.array(quantize(p["x"], v) + v.first_x, quantize(p["y"], v) + v.first_y)))
    return F.concat(head, pairs, F.array(F.lit(EOL)))


def encode(lines: Column, v: Vocabulary, max_len: int) -> Column:
    """Ids of an array of lines, cut hard at ``max_len`` with the end mark last: the last line may stay unfinished."""
    known = F.filter(lines, lambda x: x["category"].isin(*v.categories))
    body = F.concat(F.array(F.lit(BOS)), F.flatten(F.transform(known, lambda x: line_ids(x, v))))
    return F.concat(F.slice(body, 1, max_len - 1), F.array(F.lit(EOS)))


def decode(ids: DataFrame, v: Vocabulary, key: str = "token", column: str = "ids") -> DataFrame:
    """``key, line_no, category, line_type, start_type, end_type, points`` of each finished line.

    Unknown ids are skipped; the end mark ends. ``<line>`` and ``<eol>`` close a line, which counts with a category and a point;
    attributes may be anywhere in it, the last one holds; a y belongs to the x straight before it among coordinates.
    """
    rows = ids.select(key, F.posexplode(column).alias("pos", "id"))
    by = Window.partitionBy(key).orderBy("pos")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ended", F.coalesce(F.max(F.col("id") == EOS).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    rows = rows.filter(~F.col("ended") & F.col("id").between(0, v.n - 1))
    shut = F.col("id").isin(LINE, EOL)
    rows = rows.withColumns({"seg": F.coalesce(F.sum(shut.cast("int")).over(before), F.lit(0)), "shut": shut})
    inside = Window.partitionBy(key, "seg").orderBy("pos")
    is_x, is_y = F.col("id").between(v.first_x, v.first_y - 1), F.col("id").between(v.first_y, v.first_angle - 1)
    rows = rows.withColumn("open", F.coalesce(F.max(F.col("id") == PTS).over(inside), F.lit(False)) & (is_x | is_y))
    pair = Window.partitionBy(key, "seg", "open").orderBy("pos")
    rows = rows.withColumn("prior", F.lag("id").over(pair))
    last = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("pos")))
    at = F.struct("pos", ((F.col("prior") - v.first_x) * ((v.size - 1) / (v.bins - 1))).alias("x"), ((F.col("id") - v.first_y) * ((v.size - 1) / (v.bins - 1))).alias("y"))
    got = F.when(F.col("open") & is_y & F.col("prior").between(v.first_x, v.first_y - 1), at)
    name = lambda names, first: F.get(F.array(*map(F.lit, names)), F.col("id") - first)
    i = F.col("id")
    lines = rows.groupBy(key, "seg").agg(
        F.max("shut").alias("shut"),
        last(i.between(len(SPECIALS), v.first_type - 1), name(v.categories, len(SPECIALS))).alias("category"),
        F.coalesce(last(i.between(v.first_type, v.first_start - 1), name(v.line_types, v.first_type)), F.lit("")).alias("line_type"),
        F.coalesce(last(i.between(v.first_start, v.first_start + 1), name(("start", "cut"), v.first_start)), F.lit("start")).alias("start_type"),
        F.coalesce(last(i.between(v.first_start + 2, v.first_start + 3), name(("end", "cut"), v.first_start + 2)), F.lit("end")).alias("end_type"),
        F.array_sort(F.collect_list(got)).alias("got"),
    )
    lines = lines.filter(F.col("shut") & F.col("category").isNotNull() & (F.size("got") > 0))
    number = F.row_number().over(Window.partitionBy(key).orderBy("seg")) - 1
    return lines.select(key, number.alias("line_no"), "category", "line_type", "start_type", "end_type", F.transform("got", lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"))).alias("points"))


def target_prompt(first: Column, last: Column, v: Vocabulary) -> Column:
    """``<txt_xy>`` x y x y ``<txt_end>``."""
    xy = lambda p: [quantize(p["x"], v) + v.first_x, quantize(p["y"], v) + v.first_y]
    return F.array(F.lit(TEXT_XY), *xy(first), *xy(last), F.lit(TEXT_END))


def state_prefix(lines: Column, mode: str, max_lines: int, trace_points: int = 3) -> Column:
    """The lines that stand for the state before a patch: all of them, those cut at the border, the ends that are cut, or their last points."""
    cut = lambda x: (x["start_type"] == "cut") | (x["end_type"] == "cut")
    k = max(2, trace_points)

    def trace(x: Column, points: Column) -> Column:
        return F.struct(x["category"].alias("category"), x["line_type"].alias("line_type"), F.lit("cut").alias("start_type"), F.lit("cut").alias("end_type"), points.alias("points"))

    def ends(x: Column) -> Column:
        p = x["points"]
        head, tail = trace(x, F.slice(p, 1, k)), trace(x, F.reverse(F.slice(p, F.greatest(F.size(p) - k + 1, F.lit(1)), F.lit(k))))
        return F.filter(F.array(F.when(x["start_type"] == "cut", head), F.when(x["end_type"] == "cut", tail)), lambda y: y.isNotNull())

    def tips(x: Column) -> Column:
        p = x["points"]
        head, tail = trace(x, F.slice(p, 1, 1)), trace(x, F.slice(p, -1, 1))
        return F.filter(F.array(F.when(x["start_type"] == "cut", head), F.when(x["end_type"] == "cut", tail)), lambda y: y.isNotNull())

    if mode == "cut_only":
        found, spare = F.filter(lines, cut), 8
    elif mode == "cut_points":
        found, spare = F.flatten(F.transform(F.filter(lines, lambda x: F.size(x["points"]) > 0), tips)), 4
    elif mode == "cut_traces":
        found, spare = F.flatten(F.transform(F.filter(lines, lambda x: F.size(x["points"]) > 0), ends)), 4
    else:
        return F.slice(lines, 1, max_lines)
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.slice(lines, 1, spare)), 1, max_lines)


def trace_prompt(points: Column, v: Vocabulary, n_points: int = 8, max_len: int = 384) -> Column:
    """``<txt_trace>`` (x y angle)* ``<txt_end>`` of vertices picked evenly along a line, cut at ``max_len``.

    The angle is that of the vector from the vertex before to the one after, counter-clockwise on screen. A line with
    fewer than two points has no vertex.
    """
    last = F.size(points) - 1
    k = F.least(F.lit(max(2, n_points)), F.size(points))
    # as many whole vertices as fit before the length reaches max_len - 2
    most = max(1, -(-(max_len - 3) // 3))

    def vertex(i: Column) -> Column:
        a, b, p = F.get(points, F.greatest(i - 1, F.lit(0))), F.get(points, F.least(i + 1, last)), F.get(points, i)
        turn = F.pmod(F.degrees(F.atan2(-(b["y"] - a["y"]), b["x"] - a["x"])) + 360.0, F.lit(360.0))
        return F.array(quantize(p["x"], v) + v.first_x, quantize(p["y"], v) + v.first_y, quantize_angle(turn, v) + v.first_angle)

    at = lambda j: F.when(j == k - 1, last).otherwise(F.floor(j * (last.cast("double") / (k - 1)))).cast("int")
    picked = F.slice(F.transform(F.sequence(F.lit(0), k - 1), at), 1, most)
    whole = F.concat(F.array(F.lit(TRACE)), F.flatten(F.transform(picked, vertex)), F.array(F.lit(TEXT_END)))
    none = F.array(F.lit(TRACE), F.lit(TEXT_END))
    return F.when(F.coalesce(F.size(points), F.lit(0)) >= 2, F.slice(whole, 1, max_len - 1)).otherwise(none)


def text_prompt(points: Column, mode: str, v: Vocabulary, n_points: int = 8, max_len: int = 384) -> Column:
    """The prompt of a mode about the line that it points at (null or too short: nothing is pointed at)."""
    if mode == "target_xy":
        there = F.coalesce(F.size(points), F.lit(0)) >= 2
        return F.when(there, target_prompt(F.get(points, F.lit(0)), F.element_at(points, -1), v)).otherwise(F.array(F.lit(TEXT_XY), F.lit(TEXT_END)))
    if mode in ("trace_points", "pv_assisted_target"):
        return trace_prompt(points, v, n_points, max_len)
    return F.array(F.lit(TEXT_END))


def inner_ids(ids: Column) -> Column:
    """Ids without the begin and the end mark."""
    return F.when(F.size(ids) > 2, F.slice(ids, F.lit(2), F.size(ids) - 2)).otherwise(F.array().cast("array<int>"))


def state_ids(lines: Column, v: Vocabulary, mode: str, max_lines: int, max_len: int, trace_points: int = 3) -> Column:
    """The coded prefix of a state and ``<state>``."""
    return F.concat(inner_ids(encode(state_prefix(lines, mode, max_lines, trace_points), v, max_len)), F.array(F.lit(STATE)))


def full_sequence(state: Column | None, prompt: Column | None, current: Column, max_len: int) -> tuple[Column, Column]:
    """Ids of begin mark, state (``state_ids``), prompt and current sequence without its begin mark, cut at ``max_len``, and where the current part begins."""
    none = F.array().cast("array<int>")
    head = F.concat(F.array(F.lit(BOS)), none if state is None else state, none if prompt is None else prompt)
    body = F.slice(current, F.lit(2), F.greatest(F.size(current) - 1, F.lit(0)))
    whole = F.slice(F.concat(head, body), 1, max_len)
    return whole, F.least(F.size(head), F.size(whole) - 1)


def extended(base: DataFrame, v: Vocabulary) -> DataFrame:
    """``id, token, base_id``: the place of every token of ``v`` in a vocabulary ``token, id`` that is extended by those it lacks, in their order.

    Both are vocabularies: the window that numbers the new tokens holds no more than ``v`` has.
    """
    size = base.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("__size"))
    rows = table(base.sparkSession, v).join(base.select("token", F.col("id").alias("base_id")), "token", "left").crossJoin(F.broadcast(size))
    new = F.row_number().over(Window.partitionBy(F.col("base_id").isNull()).orderBy("id")) - 1
    return rows.withColumn("base_id", F.coalesce(F.col("base_id"), F.col("__size") + new).cast("int")).select("id", "token", "base_id")


def remap(rows: DataFrame, places: DataFrame, ids: str = "ids", back: bool = False) -> DataFrame:
    """``rows`` with ids of ``v`` as ids of the extended vocabulary (``extended``), or ``back``, where what is no token of ``v`` is left out."""
    one = places.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "base_id"))), lambda r: r["base_id"]).alias("__places"))
    rows = rows.crossJoin(F.broadcast(one))
    there = F.transform(ids, lambda i: F.get("__places", i))
    again = F.filter(F.transform(ids, lambda i: (F.array_position(F.col("__places"), i) - 1).cast("int")), lambda i: i >= 0)
    return rows.withColumn(ids, again if back else there).drop("__places")
