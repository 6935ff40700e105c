"""Scalar functions over text and JSON."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvage_json(c: Column) -> Column:
    """The text if it is JSON, else its outermost object, else its outermost array, else the raw text."""
    whole = F.when(F.try_parse_json(c).isNotNull(), F.trim(c))
    part = lambda p: F.when(F.try_parse_json(F.nullif(F.regexp_extract(c, p, 0), F.lit(""))).isNotNull(), F.regexp_extract(c, p, 0))
    return F.coalesce(whole, part(r"(?s)\{.*\}"), part(r"(?s)\[.*\]"), c)


def split_think(c: Column) -> tuple[Column, Column]:
    """What stands in <think>...</think> (null without), and the rest."""
    inside = F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)
    return F.when(F.contains(c, F.lit("<think>")) & F.contains(c, F.lit("</think>")), inside), F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")


def structured(c: Column) -> Column:
    """A map of what a tagged text says: think (before </think>), non_think (the rest), and for every other
    tag the JSON array of its contents in order.  A last tag that is never closed ends with the text.
    Contents that are JSON stand as such, others as JSON strings; tags inside a tag belong to its content."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    has = F.contains(c, F.lit("</think>"))
    think = F.regexp_replace(F.substring_index(c, "</think>", 1), r"^\s+|\s+$", "")
    rest = F.when(has, F.regexp_replace(F.regexp_replace(c, r"(?s)^.*?</think>", ""), r"^\s+|\s+$", "")).otherwise(trimmed)
    last = F.regexp_extract(rest, r"<([a-zA-Z_][a-zA-Z0-9_-]*)\s*>[^<]*$", 1)
    closed = F.when((last != "") & ~F.contains(rest, F.concat(F.lit("</"), last, F.lit(">"))), F.concat(rest, F.lit("</"), last, F.lit(">"))).otherwise(rest)
    pair = r"(?s)<([a-zA-Z_][a-zA-Z0-9_-]*)>(.*?)</\1>"
    tags, contents = (F.regexp_extract_all(closed, F.lit(pair), F.lit(g)) for g in (1, 2))
    value = lambda x: F.when(F.try_parse_json(x).isNotNull(), x).otherwise(F.to_json(F.array(x)))
    found = F.arrays_zip(tags.alias("tag"), contents.alias("said"))
    inner = lambda x: F.when(F.try_parse_json(x).isNotNull(), x).otherwise(F.regexp_replace(value(x), r"(?s)^\[(.*)\]$", "$1"))
    entry = lambda t: F.struct(t.alias("key"), F.concat(F.lit("["), F.array_join(F.transform(F.filter(found, lambda f: f["tag"] == t), lambda f: inner(f["said"])), ","), F.lit("]")).alias("value"))
    named = F.map_from_entries(F.transform(F.array_distinct(F.filter(tags, lambda t: ~t.isin("think", "non_think"))), entry))
    base = F.when(has, F.create_map(F.lit("think"), think, F.lit("non_think"), rest)).otherwise(F.create_map(F.lit("non_think"), rest))
    return F.map_concat(base, named)


def tool_text(name: Column, description: Column, input_schema: Column, output_schema: Column) -> Column:
    """A tool as prompts show it; schemas are JSON text, absent ones are left out."""
    part = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit("Tool Name: "), F.coalesce(name, F.lit("unknown")), F.lit("\nDescription: "), F.coalesce(description, F.lit("No description")), F.lit("\n"), part("Input Schema", input_schema), part("Output Schema", output_schema))


def merged_map(a: Column, b: Column) -> Column:
    """Entries of both maps; b's win."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def at_key(m: Column, key: Column, default: Column) -> Column:
    """The value at a key, or the default where the map lacks the key (a null value stays null)."""
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, key)).otherwise(default)


def title(c: Column) -> Column:
    """Every run of letters with its first one as a capital and the others small, whatever parts the runs."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def tag_values(c: Column, tag: str) -> Column:
    """The contents of every <tag ...>...</tag>, in order."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def strip_fences(c: Column) -> Column:
    """The content of a fenced code block, or the text."""
    return F.when(c.rlike(r"(?s)```\w*\n.*?```"), F.regexp_extract(c, r"(?s)```\w*\n(.*?)\n?```", 1)).otherwise(c)


def server_of(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def format_step(role: Column, text: Column) -> Column:
    """A step wrapped in its role's tag."""
    return F.concat(F.lit("<"), role, F.lit(">"), F.coalesce(text, F.lit("")), F.lit("</"), role, F.lit(">"))


def fill_template(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def section(c: Column, start: str, end: str) -> Column:
    """What stands between two markers, trimmed of white space; null where the first is missing.

    Without the second marker the section runs to the end of the text."""
    found = F.regexp_extract(c, rf"(?s){re.escape(start)}(.*?)(?:{re.escape(end)}|\z)", 1)
    return F.when(F.contains(c, F.lit(start)), F.regexp_replace(found, r"^\s+|\s+$", ""))


def is_client_tool(c: Column) -> Column:
    """Whether a tool name has a server and a tool part."""
    return F.coalesce(c.rlike("^[^-]+-.+"), F.lit(False))


def keyed_id(seed: int, counter: Column) -> Column:
    """A repeatable id from a seed and a counter."""
    return F.md5(F.concat(F.lit(f"{seed}:"), counter.cast("string")))


def mail_date(c: Column) -> Column:
    """A timestamp of a mail header's date ("Mon, 01 Jan 2024 10:00:00 +0000"); null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(c, r"^\s*\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


_CALLS = {"sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan, "log": F.ln, "log10": F.log10, "exp": F.exp, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "pow": F.pow, "radians": F.radians, "degrees": F.degrees}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Mod: lambda a, b: F.pmod(a, b), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b)), ast.Pow: F.pow}


def arithmetic(expression: str, columns: tuple[str, ...] = ()) -> Column:
    """A column from an arithmetic expression of numbers, the named columns and allow-listed functions, in doubles.

    The expression is parsed, never evaluated as code; anything else in it is a ValueError.
    Division by zero gives null."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return F.col(node.id).cast("double")
        if isinstance(node, ast.Name) and node.id in ("pi", "e"):
            return F.pi() if node.id == "pi" else F.e()
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            return _CALLS[node.func.id](*map(build, node.args))
        raise ValueError(f"not allowed in an expression: {ast.dump(node)[:60]}")

    return build(ast.parse(expression, mode="eval").body)
