"""Names and labels."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of categories and line types.
CATEGORIES = ("curb", "lane_line", "virtual_line")
LINE_TYPES = ("solid", "thick_solid", "dashed", "short_dashed", "others")


def category(raw: Column) -> Column:
    """Trimmed, in lower case, with underscores."""
    return F.replace(F.lower(F.trim(raw)), F.lit(" "), F.lit("_"))


def line_type(raw: Column) -> Column:
    """One of ``LINE_TYPES``; empty for none, ``others`` for what is unknown."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), "[-/_ ]+", " "))
    out = F.when(t.isin("", "none"), "").when(t == "other", "others")
    for known in LINE_TYPES:
        out = out.when(t == known.replace("_", " "), known)
    return out.otherwise("others")


def known_line_type(raw: Column, vocabulary: tuple[str, ...]) -> Column:
    """The normalised type if the vocabulary has it, else ``others`` if it has that, else empty."""
    t = line_type(raw)
    return F.when(t.isin(*vocabulary), t).when(t == "", "").otherwise("others" if "others" in vocabulary else "")


def token_key(name: Column) -> Column:
    return F.regexp_replace(name, "(_satellite)?\\.png$", "")


def gps(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of ``{lon lat}``; null where the text has no such pair."""
    number = "(-?[0-9]+(?:\\.[0-9]+)?)"
    part = lambda k: F.nullif(F.regexp_extract(text, f"\\{{\\s*{number}[\\s,]+{number}\\s*\\}}", k), F.lit("")).cast("double")
    return part(1), part(2)


# What stands for the special tokens.
SPECIAL_PHRASES = {
    "<bos>": "begin map",
    "<eos>": "end map",
    "<state>": "previous map state",
    "<txt_xy>": "xy coordinates",
    "<txt_trace>": "trace points",
    "<txt_end>": "end text",
    "<line>": "polyline",
    "<pts>": "points",
    "<eol>": "end of polyline",
}
# What stands before the name of a token of each kind.
KIND_PHRASES = {"cat": "", "lt": "", "s": "start ", "e": "end ", "x": "x coordinate ", "y": "y coordinate ", "a": "angle "}


def phrase(token: Column) -> Column:
    """Words for a token of the map vocabulary; empty for any other."""
    special = F.create_map(*[F.lit(x) for kv in SPECIAL_PHRASES.items() for x in kv])
    kinds = F.create_map(*[F.lit(x) for kv in KIND_PHRASES.items() for x in kv])
    kind = F.regexp_extract(token, "^<([a-z]+)_.*>$", 1)
    name = F.replace(F.regexp_extract(token, "^<[a-z]+_(.*)>$", 1), F.lit("_"), F.lit(" "))
    return F.coalesce(F.try_element_at(special, token), F.concat(F.try_element_at(kinds, kind), name), F.lit(""))


# What a prompt says about the state and about line types.
WITH_STATE = (
    "A serialized previous map state is provided before the current map tokens. Tokens <s_cut> and <e_cut> mark connections crossing patch borders. "
    "Use these cut endpoints to continue connectivity inside the current patch, and avoid duplicating already-updated segments."
)
WITHOUT_STATE = "No previous map state is available for this patch. Start a new serialized map for the current patch."
NO_STATE_USED = "Generate the serialized vector map for the current patch."
WITH_TYPES = "For each polyline, also output its line type using one of: {}."


def prompt_text(template: str, prefix_lines: Column | None, fixed: dict[str, object], types: tuple[str, ...] = ()) -> Column:
    """The prompt of a row: ``template`` with ``fixed`` values and what depends on the number of prefix lines (null column: no state is used).

    ``{state_instruction}``, ``{line_type_instruction}``, ``{state_prefix_count}`` and ``{state_available}`` may stand in the template; instructions
    that do not are added behind it. Any other name in it is an error.
    """
    count = F.lit(0) if prefix_lines is None else F.coalesce(prefix_lines, F.lit(0))
    state = F.lit(NO_STATE_USED) if prefix_lines is None else F.when(count > 0, WITH_STATE).otherwise(WITHOUT_STATE)
    about_types = WITH_TYPES.format(", ".join(types)) if types else ""
    by_row = {"state_instruction": state, "state_prefix_count": count.cast("string"), "state_available": F.when(count > 0, "yes").otherwise("no")}
    values = {**fixed, "line_types": ", ".join(types), "line_type_instruction": about_types}
    names = {name for _, name, _, _ in Formatter().parse(template) if name is not None}
    if names - set(values) - set(by_row):
        raise ValueError(f"the template has unknown names: {sorted(names - set(values) - set(by_row))}")
    parts = []
    for before, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(before))
        if name is not None:
            parts.append(by_row[name] if name in by_row else F.lit(str(values[name])))
    text = F.concat(*parts) if parts else F.lit("")
    extras = [] if "state_instruction" in names else [state]
    if about_types and "line_type_instruction" not in names:
        extras.append(F.lit(about_types))
    return F.concat_ws(" ", F.regexp_replace(text, "\\s+$", ""), *extras) if extras else text


def float_list(c: Column) -> Column:
    """The numbers of ``1,2.5, 3``; empty parts are left out."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: p.cast("double"))


def offset_pairs(c: Column) -> Column:
    """``x, y`` of each pair of ``dx,dy;dx,dy``; empty parts are left out."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: p != "")
    at = lambda p, k: F.trim(F.get(F.split(p, ","), F.lit(k))).cast("int")
    return F.transform(parts, lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y")))


def relative_path(c: Column, prefix: str = "./data/nuscenes/") -> Column:
    """A path without the prefix that it may begin with."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def cosine_rate(step: Column, total: int, base: float, warmup: int) -> Column:
    """The learning rate of a step: up in a line for ``warmup`` steps, then down along half a cosine."""
    done = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, total - warmup)))))
    return F.when(step < warmup, base * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(base * 0.5 * (1.0 + F.cos(F.pi() * done)))
