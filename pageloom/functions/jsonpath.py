"""JSON expressions over VARIANT columns.

A path is text in a rule. One path is taken apart while the plan is built
(:func:`path_steps`); a column of paths is taken apart by an expression
(:func:`path_plan`) and its steps, which are data, are folded over the value
(:func:`json_select`), so any number of paths make one plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FIELD_DEFAULTS = {
    "ruleTitle": ["vod_name", "name", "title"],
    "ruleLink": ["vod_id", "url", "link", "play_url"],
    "ruleImage": ["vod_pic", "pic", "cover", "coverUrl", "image"],
    "rulePubDate": ["vod_time", "time", "pubDate", "date"],
}
LIST_KEYS = ["list", "data", "result", "results", "items", "videos", "rows"]
# ---------------------------------------------------------------------------

# The grammar of paths, for expressions and for single paths alike.
QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
TOKEN = rf"(?s)\.?\.?\[(?:[^\[\]'\"]|{QUOTED}|\[(?:[^\[\]'\"]|{QUOTED})*\])*\]|\.\.?[^.\[\]'\"$]+"
IN_BRACKETS, IN_NAME = r"(?s)^\.{0,2}\[\s*(.*?)\s*\]$", r"(?s)^\.{1,2}(.*)$"
INDEX_FORM = r"^-?[0-9]{1,9}(?:\s*,\s*-?[0-9]{1,9})*$"
SLICE_FORM = r"^(-?[0-9]{0,9})\s*:\s*(-?[0-9]{0,9})\s*(?::\s*(-?[0-9]{0,9}))?$"
KEYS_FORM = rf"(?s)^(?:{QUOTED})(?:\s*,\s*(?:{QUOTED}))*$"
FILTER_FORM = r"(?s)^\?\s*\((.*)\)$"
# One test of a filter: a path from the member, a sign and a constant, or the path alone.
TEST_FORM = (
    r"(?s)^\s*@((?:\.[A-Za-z_][A-Za-z0-9_-]*|\[[0-9]+\]|\['[^'?]+'\])*)\s*(?:(==|!=|<=|>=|<|>)\s*"
    r"('[^']*'|\"[^\"]*\"|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))?\s*$")
OUTSIDE = r"(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)"  # of quotes
EITHER, BOTH = r"\|\|" + OUTSIDE, "&&" + OUTSIDE

TEST_TYPE = "struct<path:string,sign:string,constant:string>"
STEP_TYPE = f"struct<deep:boolean,op:string,keys:array<string>,at:array<int>,low:int,high:int,by:int,tests:array<array<{TEST_TYPE}>>>"
VARIANTS = "array<variant>"


@dataclass
class PathStep:
    """One step: what it takes of each value; ``deep`` steps look at every level below first."""

    deep: bool
    op: str
    keys: list[str] | None = None
    at: list[int] | None = None
    low: int | None = None
    high: int | None = None
    by: int | None = None
    tests: list[list[tuple[str, str, str]]] | None = None


def _rooted(text: str) -> str:
    return text[1:] if text[:1] in ("$", "@") else "." + text


def path_steps(path: str) -> list[PathStep] | None:
    """Steps of a dotted or ``$`` path; ``None`` when the text is no path."""
    text = path.strip()
    if text in ("", "$", "@", "."):
        return []
    rest = _rooted(text)
    tokens = re.findall(TOKEN, rest)
    if "".join(tokens) != rest:
        return None
    steps = []
    for token in tokens:
        deep, inner = token.startswith(".."), re.match(IN_BRACKETS, token)
        if inner is None:
            name = re.match(IN_NAME, token)[1].strip()
            steps.append(PathStep(deep, "all") if name == "*" else PathStep(deep, "key", [name]))
            continue
        inner = inner[1]
        if inner == "*":
            steps.append(PathStep(deep, "all"))
        elif re.match(INDEX_FORM, inner):
            steps.append(PathStep(deep, "index", at=[int(x) for x in inner.split(",")]))
        elif (m := re.match(SLICE_FORM, inner)) and "-" not in m.groups(""):
            low, high, by = (int(x) if x else None for x in m.groups())
            steps.append(PathStep(deep, "slice", low=low, high=high, by=by))
        elif re.match(KEYS_FORM, inner):
            steps.append(PathStep(deep, "key", [re.sub(r"\\(.)", r"\1", q[1:-1]) for q in re.findall(QUOTED, inner)]))
        elif m := re.match(FILTER_FORM, inner):
            tests = [[re.match(TEST_FORM, t) for t in re.split(BOTH, every)] for every in re.split(EITHER, m[1])]
            if not all(t for every in tests for t in every):
                return None
            steps.append(PathStep(deep, "filter", tests=[[("$" + t[1], t[2] or "", t[3] or "") for t in every] for every in tests]))
        else:
            return None
    return steps


def path_plan(path: Column) -> Column:
    """The same for a column of paths: ``array<STEP_TYPE>``, null where the text is no path."""
    return let(F.trim(path), _path_plan)


def _path_plan(text: Column) -> Column:
    rest = F.when(text.rlike(r"^[$@]"), F.substr(text, F.lit(2))).otherwise(F.concat(F.lit("."), text))
    none = F.lit(None).cast(f"array<{STEP_TYPE}>")
    tokens = F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0))

    def step(t: Column) -> Column:
        parts = F.struct(t.startswith("..").alias("deep"), t.rlike(IN_BRACKETS).alias("bracket"), F.regexp_extract(t, IN_BRACKETS, 1).alias("inner"),
                         F.trim(F.regexp_extract(t, IN_NAME, 1)).alias("name"))
        return let(parts, lambda p: _plan_step(p["deep"], p["bracket"], p["inner"], p["name"]))

    def whole(steps: Column) -> Column:
        return F.when((F.array_join(tokens, "") == rest) & F.forall(steps, lambda s: s["op"].isNotNull()), steps).otherwise(none)

    return F.when(text.isin("", "$", "@", "."), F.array().cast(f"array<{STEP_TYPE}>")).when(text.isNotNull(), let(F.transform(tokens, step), whole))


def _plan_step(deep: Column, bracket: Column, inner: Column, name: Column) -> Column:
    bound = lambda g: F.nullif(F.regexp_extract(inner, SLICE_FORM, g), F.lit(""))

    def test(x: Column) -> Column:
        return F.struct(*[F.when(x.rlike(TEST_FORM), F.concat(F.lit(before), F.regexp_extract(x, TEST_FORM, g))).alias(n)
                          for g, n, before in ((1, "path", "$"), (2, "sign", ""), (3, "constant", ""))])

    def built(tests: Column) -> Column:
        op = (
            F.when(~bracket, F.when(name == "*", "all").otherwise("key")).when(inner == "*", "all").when(inner.rlike(INDEX_FORM), "index")
            .when(inner.rlike(SLICE_FORM) & ~inner.rlike(r"-\s*(:|$)"), "slice").when(inner.rlike(KEYS_FORM), "key")
            .when(inner.rlike(FILTER_FORM) & F.forall(F.flatten(tests), lambda x: x["path"].isNotNull()), "filter"))
        quoted = F.transform(F.regexp_extract_all(inner, F.lit(QUOTED), F.lit(0)),
                             lambda q: F.regexp_replace(F.substr(q, F.lit(2), F.length(q) - 2), r"\\(.)", "$1"))
        return F.struct(
            deep.alias("deep"), op.alias("op"), F.when(bracket, quoted).otherwise(F.array(name)).alias("keys"),
            F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("int")).alias("at"),
            *[bound(g).try_cast("int").alias(n) for g, n in ((1, "low"), (2, "high"), (3, "by"))], tests.alias("tests")).cast(STEP_TYPE)

    terms = F.transform(F.split(F.regexp_extract(inner, FILTER_FORM, 1), EITHER), lambda e: F.transform(F.split(e, BOTH), test))
    return let(terms, built)


def let(value: Column, body) -> Column:
    """``body`` of a value that it names several times and that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _members(v: Column) -> Column:
    return F.try_variant_get(v, F.lit("$"), "map<string,variant>")


def _get(v: Column, key: str | Column) -> Column:
    """The member under a key; a key that a variant's own paths cannot write is looked up among all."""
    if isinstance(key, str):
        if re.search(r"['?]", key) or not key:
            return F.try_element_at(_members(v), F.lit(key))
        return F.try_variant_get(v, F.lit(f"$['{key}']"), "variant")
    plain = F.try_variant_get(v, F.concat(F.lit("$['"), key, F.lit("']")), "variant")
    return F.when(key.rlike("['?]") | (key == ""), F.try_element_at(_members(v), key)).otherwise(plain)


def json_items(v: Column) -> Column:
    """The elements of a JSON array, null for anything else."""
    return F.try_variant_get(v, F.lit("$"), VARIANTS)


def _compact(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def _none() -> Column:
    return F.array().cast(VARIANTS)


def _inside(v: Column) -> Column:
    """Elements of an array, values of an object."""
    return F.coalesce(json_items(v), F.map_values(_members(v)), _none())


def _by_index(v: Column, at: Column) -> Column:
    chosen = lambda items: F.transform(at, lambda i: F.get(items, F.when(i < 0, F.size(items) + i).otherwise(i)))
    return F.coalesce(let(json_items(v), chosen), _none())


def _by_slice(v: Column, low: Column, high: Column, by: Column) -> Column:
    by = F.coalesce(by, F.lit(1))

    def sliced(items: Column) -> Column:
        n = F.size(items)
        placed = lambda x, least, most: F.when(x.isNotNull(), F.greatest(F.lit(least), F.least(most, F.when(x < 0, n + x).otherwise(x))))
        up_from, up_to = F.coalesce(placed(low, 0, n), F.lit(0)), F.coalesce(placed(high, 0, n), n)
        down_from, down_to = F.coalesce(placed(low, -1, n - 1), n - 1), F.coalesce(placed(high, -1, n - 1), F.lit(-1))
        upward = F.filter(items, lambda _, i: (i >= up_from) & (i < up_to) & ((i - up_from) % by == 0))
        downward = F.reverse(F.filter(items, lambda _, i: (i <= down_from) & (i > down_to) & ((down_from - i) % by == 0)))
        return F.when(by > 0, upward).when(by < 0, downward).otherwise(_none())

    return let(F.coalesce(json_items(v), _none()), sliced)


def _holds(v: Column, test: Column) -> Column:
    """Does a member pass one test? Values of another type than the constant's, and missing ones, do not."""
    constant, sign = test["constant"], test["sign"]
    signed = lambda a, b: (
        F.when(sign == "==", a == b).when(sign == "!=", a != b).when(sign == "<", a < b).when(sign == "<=", a <= b)
        .when(sign == ">", a > b).otherwise(a >= b))

    def passes(found: Column) -> Column:
        kind, as_ = F.regexp_extract(F.schema_of_variant(found), r"^[A-Z]+", 0), lambda t: F.try_variant_get(found, F.lit("$"), t)
        return (
            F.when(sign == "", found.isNotNull())
            .when(constant.rlike("^['\"]"), (kind == "STRING") & signed(as_("string"), F.substr(constant, F.lit(2), F.length(constant) - 2)))
            .when(constant.rlike("^[-0-9]"), kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & signed(as_("double"), constant.try_cast("double")))
            .when(constant == "null", found.isNotNull() & signed((kind == "VOID").cast("int"), F.lit(1)))
            .otherwise((kind == "BOOLEAN") & signed(as_("boolean").cast("int"), (constant == "true").cast("int"))))

    return F.coalesce(let(F.try_variant_get(v, test["path"], "variant"), passes), F.lit(False))


def _by_filter(v: Column, tests: Column) -> Column:
    return F.filter(_inside(v), lambda x: F.exists(tests, lambda every: F.forall(every, lambda t: _holds(x, t))))


def _by_keys(v: Column, keys: list[str] | Column, deep: bool | Column) -> Column:
    """Members under keys; an array met on the way is entered, unless every level is looked at anyway."""
    if isinstance(keys, list):
        take = lambda y: F.array(*[_get(y, k) for k in keys])
    else:
        take = lambda y: F.transform(keys, lambda k: _get(y, k))
    items = F.when(F.lit(deep) if isinstance(deep, bool) else deep, F.lit(None).cast(VARIANTS)).otherwise(json_items(v))
    return F.coalesce(F.flatten(F.transform(items, take)), take(v))


NODE_TYPE = "struct<path:array<string>,value:variant>"


def descend(values: Column, depth: Column) -> Column:
    """Values and all that lies in them, each before what it holds: ``array<NODE_TYPE>``; ``depth`` as :func:`nesting` gives it."""
    element = lambda i: F.concat(F.lit("#"), F.lpad(i.cast("string"), 9, "0"))
    node = lambda path, value: F.struct(path.alias("path"), value.alias("value")).cast(NODE_TYPE)

    def below(n: Column) -> Column:
        elements = F.transform(json_items(n["value"]), lambda x, i: node(F.array_append(n["path"], element(i)), x))
        fields = F.transform(F.map_entries(_members(n["value"])), lambda e: node(F.array_append(n["path"], e["key"]), e["value"]))
        return F.coalesce(elements, fields, F.array().cast(f"array<{NODE_TYPE}>"))

    state = lambda level, all_: F.struct(level.alias("level"), all_.alias("all"))

    def deeper(acc: Column, _: Column) -> Column:
        level = F.flatten(F.transform(acc["level"], below))
        return state(level, F.concat(acc["all"], level))

    turns = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    start = F.transform(values, lambda x, i: node(F.array(element(i)), x))
    every = let(start, lambda first: F.aggregate(turns, state(first, first), deeper, lambda acc: acc["all"]))
    # Sorted by path alone: values have no order.
    places = lambda all_: F.array_sort(F.transform(all_, lambda n, i: F.struct(n["path"].alias("path"), i.alias("i"))))
    return let(every, lambda all_: F.transform(places(all_), lambda p: F.get(all_, p["i"])))


def _depth(v: Column) -> Column:
    return F.coalesce(nesting(F.to_json(v)), F.lit(0))


def _below(values: Column, depth: Column) -> Column:
    return F.transform(descend(values, depth), lambda n: n["value"])


def _taken(s: PathStep):
    """What a step of a given path takes of one value."""
    if s.op == "key":
        return lambda x: _by_keys(x, s.keys, s.deep)
    if s.op == "index":
        return lambda x: _by_index(x, F.array(*map(F.lit, s.at)))
    if s.op == "slice":
        return lambda x: _by_slice(x, *[F.lit(b).cast("int") for b in (s.low, s.high, s.by)])
    if s.op == "filter":
        test = lambda t: F.struct(*[F.lit(a).alias(n) for a, n in zip(t, ("path", "sign", "constant"))])
        return lambda x: _by_filter(x, F.array(*[F.array(*map(test, every)) for every in s.tests]))
    return _inside


def json_values(v: Column, path: str) -> Column:
    """Every value a path reaches, as ``array<variant>``; arrays met on the way are entered."""
    steps = path_steps(path)
    out = F.array(v)
    for s in steps or []:
        base = _below(out, _depth(v)) if s.deep else out
        out = _compact(F.flatten(F.transform(base, _taken(s))))
    return _none() if steps is None else F.coalesce(_compact(out), _none())


def json_select(v: Column, steps: Column) -> Column:
    """The same for a column of steps (:func:`path_plan`): one plan, whatever paths the rows hold."""
    depth = F.when(F.exists(steps, lambda s: s["deep"]), _depth(v)).otherwise(0)

    def step(values: Column, s: Column) -> Column:
        base = F.when(s["deep"], _below(values, depth)).otherwise(values)
        return _compact(F.flatten(F.transform(base, lambda x: (
            F.when(s["op"] == "key", _by_keys(x, s["keys"], s["deep"])).when(s["op"] == "index", _by_index(x, s["at"]))
            .when(s["op"] == "all", _inside(x)).when(s["op"] == "slice", _by_slice(x, s["low"], s["high"], s["by"]))
            .otherwise(_by_filter(x, s["tests"]))))))

    return F.coalesce(_compact(F.aggregate(steps, F.array(v), step)), _none())


def json_text(v: Column) -> Column:
    """A JSON value as rule text: strings bare, null empty, the rest as JSON."""
    return F.coalesce(F.try_variant_get(v, F.lit("$"), "string"), F.lit(""))


def json_path(v: Column, path: str) -> Column:
    """The texts a path reaches, in document order."""
    return F.transform(json_values(v, path), json_text)


def first_text(values: Column) -> Column:
    """The first value that is not blank, else the empty string."""
    return F.coalesce(F.get(F.filter(values, lambda x: F.trim(x) != ""), F.lit(0)), F.lit(""))


def split_branches(rule: str) -> list[str]:
    """Branches of a rule at ``||`` outside quotes and ``{{ }}``."""
    string = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\""
    hole = rf"\{{\{{(?:{string}|(?!\}}\}}).)*\}}\}}"
    branches = [""]
    for m in re.finditer(rf"{string}|{hole}|['\"].*|\|\||.", rule, re.S):
        if m[0] == "||":
            branches.append("")
        else:
            branches[-1] += m[0]
    return [b.strip() for b in branches if b.strip()]


def split_branches_by(rule: Column) -> Column:
    """:func:`split_branches` for a column of rules without holes."""
    return F.filter(F.transform(F.split(rule, EITHER), F.trim), lambda b: b != "")


def json_first_of(v: Column, paths: list[str] | str) -> Column:
    """E5: the first non-blank text over fallback branches."""
    branches = split_branches(paths) if isinstance(paths, str) else paths
    return F.coalesce(*[F.nullif(first_text(json_path(v, p)), F.lit("")) for p in branches], F.lit(""))


def json_steps(values: Column, steps: list[tuple[str, str]]) -> Column:
    """Rule steps over ``array<variant>``; a property name ends the rule."""
    out = values
    for op, arg in steps:
        if op in ("all", "children", "child"):
            out = F.flatten(_compact(F.transform(out, json_items)))
        elif op == "next":
            out = F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(0)))
        elif op == "prev":
            out = F.slice(F.reverse(out), 2, F.greatest(F.size(out) - 1, F.lit(0)))
        elif op in ("attr", "select"):
            return F.transform(out, lambda x: json_text(_get(x, arg)))
    return F.transform(out, json_text)


def json_field_default(v: Column, field: str) -> Column:
    """The value under the usual key names of a content API."""
    keys = FIELD_DEFAULTS.get(field, FIELD_DEFAULTS["rulePubDate"])
    texts = [json_text(_get(v, k)) for k in keys]
    return F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts], F.lit(""))


def lookup_verdict(values: Column, path_ok: Column) -> Column:
    """Why a lookup returned nothing; only ``bad_path`` blames the rule."""
    return let(values, lambda found: (
        F.when(~path_ok, F.lit("bad_path"))
        .when(F.size(found) == 0, F.lit("no_match"))
        .when(F.forall(found, lambda x: F.trim(x) == ""), F.lit("empty_values"))
        .otherwise(F.lit("values"))))


def is_json_body(body: Column) -> Column:
    """Does a response body hold a JSON object or array?"""
    return F.coalesce(body.rlike(r"^\s*[{\[]"), F.lit(False)) & F.try_parse_json(body).isNotNull()


def nesting(body: Column) -> Column:
    """How deep the brackets of a JSON text nest."""
    # Escapes go first so that strings end at the next quote; no pattern here loops
    # over a group, which on long texts would exhaust the regex engine's stack.
    plain = F.regexp_replace(F.regexp_replace(body, r"\\.", ""), r'"[^"]*+"', "")
    brackets = F.regexp_replace(plain, r"[^{}\[\]]++", "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def step(acc: Column, b: Column) -> Column:
        at = acc["at"] + F.when(b.isin("{", "["), 1).when(b == "", 0).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(acc["top"], at).alias("top"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["top"])


def json_tree(bodies: DataFrame, text: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Every value of every JSON text as a row: ``keep + path, key, depth, value``.

    Each text is walked level by level in one expression, as often as its own brackets nest:
    no shuffle, nothing to find out first, and a deep text costs the others nothing.
    """
    keep = keep or [c for c in bodies.columns if c != text]
    v = F.try_parse_json(F.col(text))
    rows = bodies.select(*keep, F.explode(descend(F.array(v), F.when(v.isNotNull(), nesting(F.col(text))).otherwise(0))).alias("at"))
    path = F.slice("at.path", 2, F.size("at.path") - 1)  # without the text's own place
    rows = rows.select(*keep, path.alias("path"), F.when(F.size("at.path") > 1, F.element_at("at.path", -1)).otherwise("").alias("key"),
                       (F.size("at.path") - 1).alias("depth"), F.col("at.value").alias("value"))
    return rows.filter(F.col("value").isNotNull())


def json_descend(bodies: DataFrame, key: str, text: str = "body", keep: list[str] | None = None) -> DataFrame:
    """E4, ``$..key``: every value under ``key`` at any level, with its path."""
    return json_tree(bodies, text, keep).filter(F.col("key") == key).withColumn("text", json_text(F.col("value")))


def json_list_rule(v: Column, body: Column) -> Column:
    """Where a body keeps its list: a known key, else the first array of objects; empty when there is none."""
    known = F.coalesce(*[
        F.when(F.size(F.try_variant_get(v, F.lit(f"$['{k}']"), VARIANTS)) > 0, F.lit(f"$.{k}"))
        for k in LIST_KEYS])
    holds_object = lambda x: F.exists(json_items(x), lambda y: _members(y).isNotNull())
    own = lambda n: F.element_at(n["path"], -1)
    lists = F.filter(descend(F.array(v), F.coalesce(nesting(body), F.lit(0))), lambda n: (
        (F.size(n["path"]) > 1) & ~own(n).startswith("#") & F.coalesce(holds_object(n["value"]), F.lit(False))))
    # An object's own array members come before anything deeper in it, and the
    # objects themselves are met in document order: parent path, then key.
    first = F.array_min(F.transform(lists, lambda n: F.struct(F.slice(n["path"], 1, F.size(n["path"]) - 1).alias("parent"), own(n).alias("k"))))
    return F.when(v.isNull(), F.lit("")).otherwise(F.coalesce(known, F.concat(F.lit("$."), first["k"]), F.lit("")))


def infer_json_list(bodies: DataFrame, key: str, text: str = "body") -> DataFrame:
    """E11 as rows: ``key, rule``; the rule is empty when a body holds no such array."""
    return bodies.select(key, json_list_rule(F.try_parse_json(F.col(text)), F.col(text)).alias("rule"))
