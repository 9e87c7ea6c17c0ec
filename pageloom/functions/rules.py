"""Rule text: classes of rules, templates, clean-up operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.jsonpath import (
    STEP_TYPE, first_text, json_field_default, json_first_of, json_path, json_select, json_text, let, path_plan, path_steps, split_branches_by)
from pageloom.functions.text import executable

# --- fixed values -----------------------------------------------------------
SCRIPT_MARKS = ["java.", "evalJS(", "cache."]
CENSUS_CONSTRUCTS = [":matches(", ":contains(", ":starts-with(", ":ends-with(", ":regex(", "@XPath", "$.", "$$."]
# ---------------------------------------------------------------------------


def looks_like_script(rule: Column) -> Column:
    r = F.trim(rule)
    out = r.startswith("@js:") | r.startswith("<js>") | r.startswith("<js ")
    for mark in SCRIPT_MARKS:
        out = out | r.contains(mark)
    return out


def classify_rule(rule: Column) -> Column:
    """Script, template, regex, json, xpath, plain or empty."""
    r = F.trim(rule)
    return (
        F.when(r == "", F.lit("empty"))
        .when(looks_like_script(r), F.lit("script"))
        .when(r.contains("{{"), F.lit("template"))
        .when(r.contains("##"), F.lit("regex"))
        .when(r.startswith("$") | r.startswith("@"), F.lit("json"))
        .when(r.startswith("//") | r.startswith("./") | r.endswith("text()") | r.contains("[@"), F.lit("xpath"))
        .otherwise(F.lit("plain"))
    )


def _replacement(text: str, groups: int, names: dict[str, str]) -> str:
    """A ``$n`` / ``${n}`` replacement in the form Java's regex expects; unknown groups are empty, other ``$`` stay."""

    def one(m: re.Match) -> str:
        name = m.group(1) or m.group(2)
        if name is None:
            return r"\$"
        if name.isdigit():
            return f"${name}" if int(name) <= groups else ""
        return f"${{{names[name]}}}" if name in names else ""

    out = text.replace("\\", "\\\\")
    return re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$", one, out)


def regex_op(c: Column, pattern: str, replacement: str = "", ignore_case: bool = False) -> Column:
    """Replace every match; a pattern that does not compile changes nothing."""
    found = executable(pattern)
    if found is None:
        return c
    pattern, groups, names = found
    flags = "(?i)" if ignore_case else ""
    return F.regexp_replace(c, f"{flags}{pattern}", _replacement(replacement, groups, names))


def regex_suffix(c: Column, suffix: str) -> Column:
    """Apply the ``pattern##replacement`` half of a ``text##pattern##replacement`` rule."""
    pattern, _, replacement = suffix.partition("##")
    ignore_case = pattern.endswith("!")
    return regex_op(c, pattern[:-1] if ignore_case else pattern, replacement, ignore_case)


def render_template(v: Column, template: str, now: Column | None = None) -> Column:
    """Fill ``{{path}}`` holes from a JSON value.

    Holes may carry a ``##pattern##replacement`` tail; script holes render empty
    because scripts are reported, not run.
    """
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{\{(.+?)\}\}", template, re.S):
        if m.start() > at:
            parts.append(F.lit(template[at:m.start()]))
        expr, hash_mark, tail = m.group(1).strip().partition("##")
        expr = expr.strip()
        if expr in ("now", "$.now"):
            value = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        elif not expr or expr.startswith("@js:") or expr.startswith("<js>") or path_steps(expr) is None:
            value = F.lit("")
        else:
            value = F.coalesce(F.get(json_path(v, expr), F.lit(0)), F.lit(""))
        parts.append(regex_suffix(value, tail) if hash_mark else value)
        at = m.end()
    if at < len(template) or not parts:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def json_field(v: Column, rule: str, field: str) -> Column:
    """The value of one field rule on a JSON container, defaults included."""
    tries = []
    text = rule.strip()
    if text and "##" not in text and "{{" not in text:
        tries.append(json_first_of(v, text))
    elif "{{" in text:
        tries.append(render_template(v, text))
    elif text:
        subject, _, tail = text.partition("##")
        tries.append(regex_suffix(first_text(json_path(v, subject)), tail))
    tries.append(json_field_default(v, field))
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in tries], F.lit(""))


# --- rules as data ---------------------------------------------------------------


def _checked(pattern: Column) -> Column:
    """A pattern that the regex engine takes, null for any other."""
    return F.when(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("matches"), pattern, F.lit("")).isNotNull(), pattern)


def _checked_replacement(text: Column, pattern: Column) -> Column:
    """:func:`_replacement` for columns."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[[^\]]*\]", "")
    groups = F.regexp_count(bare, F.lit(r"\((?!\?)|\(\?<[A-Za-z]"))

    def one(t: Column) -> Column:
        name = F.regexp_extract(t, r"^\$\{?(\w+)\}?$", 1)
        known = pattern.contains(F.concat(F.lit("(?<"), name, F.lit(">")))
        return (
            F.when(t.isin("$", "$$"), F.lit(r"\$")).when(t == "\\", F.lit("\\\\")).when(name == "", t)
            .when(name.rlike("^[0-9]+$"), F.when(name.try_cast("int") <= groups, F.concat(F.lit("$"), name)).otherwise(""))
            .when(known, F.concat(F.lit("${"), name, F.lit("}"))).otherwise(""))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(\$\$|\$\{\w+\}|\$\w+|\$|\\|[^$\\]+)"), F.lit(1)), one), "")


def _cleaned_by(suffix: Column) -> tuple[Column, Column]:
    """Pattern and replacement of a ``pattern##replacement`` half; a pattern that does not compile is null."""
    raw = F.substring_index(suffix, "##", 1)
    pattern = _checked(F.when(raw.endswith("!"), F.concat(F.lit("(?i)"), F.substr(raw, F.lit(1), F.length(raw) - 1))).otherwise(raw))
    by = F.when(suffix.contains("##"), F.substr(suffix, F.instr(suffix, "##") + 2)).otherwise("")
    return pattern, _checked_replacement(by, pattern)


PIECE_TYPE = "struct<text:string,hole:boolean,now:boolean,pattern:string,by:string>"
RULE_TYPE = f"struct<template:boolean,plans:array<array<{STEP_TYPE}>>,pieces:array<{PIECE_TYPE}>,pattern:string,by:string>"


def rule_plan(rule: Column) -> Column:
    """A column of JSON rules taken apart: the paths of its branches, or of the pieces of a template, and the clean-up behind ``##``."""
    return let(F.trim(rule), _rule_plan)


def _behind(text: Column) -> Column:
    return F.when(text.contains("##"), F.substr(text, F.instr(text, "##") + 2))


def _rule_plan(text: Column) -> Column:
    template = text.contains("{{")
    inner_of = lambda t: F.trim(F.regexp_extract(t, r"(?s)^\{\{(.+)\}\}$", 1))
    subject_of = lambda t: F.trim(F.substring_index(t, "##", 1))
    none = F.lit(None).cast("string")

    def piece(t: Column) -> Column:
        inner = inner_of(t)
        pattern, by = _cleaned_by(_behind(inner))
        return F.struct(t.alias("text"), (inner != "").alias("hole"), subject_of(inner).isin("now", "$.now").alias("now"),
                        pattern.alias("pattern"), by.alias("by")).cast(PIECE_TYPE)

    def path_of(t: Column) -> Column:
        path = subject_of(inner_of(t))
        return F.when((path != "") & ~path.startswith("@js:") & ~path.startswith("<js>"), path).otherwise(none)

    pieces = F.filter(F.split(text, r"(?=\{\{)|(?<=\}\})"), lambda t: t != "")
    paths = (
        F.when(template, F.transform(pieces, path_of)).when(text.contains("##"), F.array(subject_of(text)))
        .otherwise(split_branches_by(text)))
    pattern, by = _cleaned_by(_behind(text))
    return F.struct(
        template.alias("template"), F.transform(paths, path_plan).alias("plans"), F.when(template, F.transform(pieces, piece)).alias("pieces"),
        F.when(~template, pattern).alias("pattern"), F.when(~template, by).alias("by")).cast(RULE_TYPE)


def json_by_rule(v: Column, plan: Column, now: Column | None = None) -> Column:
    """What a rule taken apart (:func:`rule_plan`) makes of a JSON value; nothing where it finds nothing."""
    moment = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    cleaned = lambda value, by: F.when(by["pattern"].isNotNull(), F.regexp_replace(value, by["pattern"], by["by"])).otherwise(value)

    def value(steps: Column) -> Column:
        # A hole takes the first value, a branch the first that is not blank.
        return let(F.transform(json_select(v, steps), json_text), lambda texts: F.coalesce(
            F.when(plan["template"], F.get(texts, F.lit(0))).otherwise(first_text(texts)), F.lit("")))

    def shown(values: Column) -> Column:
        filled = F.zip_with(plan["pieces"], values, lambda p, x: F.when(
            p["hole"], cleaned(F.when(p["now"], moment).otherwise(F.coalesce(x, F.lit(""))), p)).otherwise(p["text"]))
        return F.when(plan["template"], F.array_join(filled, "")).otherwise(cleaned(first_text(values), plan))

    return let(F.transform(plan["plans"], value), shown)


def json_fields_by(v: Column, plans: Column, fields: list[str]) -> Column:
    """:func:`json_field` for an array of rules taken apart, one for each of ``fields``."""
    found = F.transform(plans, lambda plan: json_by_rule(v, plan))
    usual = F.array(*[json_field_default(v, field) for field in fields])
    return F.zip_with(found, usual, lambda a, b: F.when(F.trim(a) != "", a).otherwise(b))


def fill_vars(template: Column, values: Column) -> Column:
    """Fill ``{{k}}`` and ``<k>`` slots from a map, in key order."""
    entries = F.array_sort(F.map_entries(values))

    def step(acc: Column, e: Column) -> Column:
        braces = F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"])
        return F.replace(braces, F.concat(F.lit("<"), e["key"], F.lit(">")), e["value"])

    return F.aggregate(entries, template, step)


def parse_headers(header: Column) -> Column:
    """A JSON object or ``Name: value`` lines as ``map<string,string>``."""
    raw = F.trim(header)
    # Nested values carry no header; only scalars survive.
    members = F.try_variant_get(F.try_parse_json(raw), F.lit("$"), "map<string,variant>")
    kind = lambda x: F.regexp_extract(F.schema_of_variant(x), r"^[A-Z]+", 0)
    scalars = F.map_filter(members, lambda k, x: ~kind(x).isin("OBJECT", "ARRAY", "VOID"))
    from_json = F.transform_values(scalars, lambda k, x: F.try_variant_get(x, F.lit("$"), "string"))
    lines = F.filter(F.split(raw, r"\r?\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(
        F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    named = F.filter(pairs, lambda p: p["key"] != "")
    # A header written twice keeps its last value.
    last = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda acc, p: F.map_concat(
        F.map_filter(acc, lambda k, v: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))))
    empty = F.create_map().cast("map<string,string>")
    return F.when(raw == "", empty).when(raw.startswith("{"), F.coalesce(from_json, empty)).otherwise(last)
