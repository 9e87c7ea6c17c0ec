"""Any number of rules over any number of pages, as one plan per step.

Rules are rows. A step joins the frontier with the step rows that apply to it,
so adding a rule adds rows, not operators. Only the set of operators in use per
step (a handful of words) reaches the driver; rule text never does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import html_to_text
from pageloom.operators.nodes import page_texts
from pageloom.operators.select import (
    FRONTIER, KEYS, PREFIXES, TERMINAL, XPATH_SEGMENT, XPATH_SKIPPED, XPATH_TAIL, best_text_matches, class_list, compile_rules, node_text, text_candidates,
    with_last,
)
from pageloom.operators.within import inside
from pageloom.session import Scratch, joining_in_place, materialize

RUNNING = [*FRONTIER, "last"]  # a frontier under way knows where its nodes end


def selector_parts(css: Column) -> Column:
    """A selector as ``array<struct<tag,id,classes,attr,value,nth>>``, outermost first."""
    text = F.trim(css)
    for pattern, by in PREFIXES:
        text = F.regexp_replace(text, pattern, by)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def part(w: Column) -> Column:
        bare = F.regexp_replace(w, r"\[[^\]]*\]|:nth-of-type\(\d+\)", "")
        return F.struct(
            F.lower(F.regexp_extract(bare, r"^([A-Za-z][\w-]*)", 1)).alias("tag"),
            F.regexp_extract(bare, r"#([^.#]+)", 1).alias("id"),
            F.regexp_extract_all(bare, F.lit(r"\.([^.#]+)"), F.lit(1)).alias("classes"),
            F.regexp_extract(w, r"\[([\w:-]+)", 1).alias("attr"),
            F.when(w.rlike(r"\[[\w:-]+="), F.regexp_extract(w, r"=['\"]?([^'\"\]]*)", 1)).alias("value"),
            F.coalesce(F.regexp_extract(w, r":nth-of-type\((\d+)\)", 1).try_cast("int"), F.lit(0)).alias("nth"),
        )

    return F.transform(F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("*"))), part)


def _xpath_css(path: Column) -> Column:
    """The selector an XPath stands for (C6) as an expression."""
    segments = F.filter(F.transform(F.split(F.regexp_replace(path, XPATH_TAIL, ""), "/"), F.trim), lambda s: ~s.isin(XPATH_SKIPPED))

    def css(s: Column) -> Column:
        for pattern, by in XPATH_SEGMENT:
            s = F.regexp_replace(s, pattern, by)
        return s

    return F.array_join(F.transform(segments, css), " ")


def plan_steps(rules: DataFrame) -> DataFrame:
    """C2 steps made ready to run: XPath translated, selectors taken apart."""
    steps = compile_rules(rules)
    steps = steps.withColumn("arg", F.when(F.col("op").startswith("xpath"), _xpath_css(F.col("arg"))).otherwise(F.col("arg")))
    # "//a/text()" asks for the text of what it selects: a step of its own.
    twice = F.when(F.col("op") == "xpath_text", F.array(F.lit("select"), F.lit("text"))).when(
        F.col("op") == "xpath", F.array(F.lit("select"))).otherwise(F.array("op"))
    steps = steps.select("rule_id", "step_no", F.posexplode(twice).alias("half", "op"), "arg", "n")
    order = Window.partitionBy("rule_id").orderBy("step_no", "half")
    steps = steps.withColumn("step_no", F.row_number().over(order) - 1)
    parts = F.when(F.col("op").isin("select", "indexed"), selector_parts(F.col("arg")))
    simple = ~F.trim(F.col("arg")).rlike(r"[\s\[:]")
    return steps.select("rule_id", "step_no", "op", "arg", "n", parts.alias("parts"), simple.alias("simple"))


def _tokens() -> Column:
    """What an element can be looked up by: its tag, classes, id, and ``*``."""
    classes = F.transform(F.filter(class_list(F.col("attrs")), lambda c: c != ""), lambda c: F.concat(F.lit("."), c))
    ident = F.when(F.col("attrs")["id"] != "", F.array(F.concat(F.lit("#"), F.col("attrs")["id"])))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(F.col("tag"), F.lit("*")), classes, F.coalesce(ident, none)))


def _part_token(p: Column) -> Column:
    return (
        F.when(p["id"] != "", F.concat(F.lit("#"), p["id"]))
        .when(F.size(p["classes"]) > 0, F.concat(F.lit("."), F.get(p["classes"], F.lit(0))))
        .when(p["tag"] != "", p["tag"]).otherwise(F.lit("*"))
    )


def _part_holds(p: Column) -> Column:
    attrs = F.col("attrs")
    return (
        ((p["tag"] == "") | (p["tag"] == F.col("tag")))
        & ((p["id"] == "") | (F.coalesce(attrs["id"], F.lit("")) == p["id"]))
        & F.forall(p["classes"], lambda c: F.array_contains(class_list(attrs), c))
        & ((p["attr"] == "") | F.coalesce(F.when(p["value"].isNull(), attrs[p["attr"]].isNotNull())
                                          .otherwise(attrs[p["attr"]] == p["value"]), F.lit(False)))
        & ((p["nth"] == 0) | (p["nth"] == F.col("type_ix")))
    )


BROADCAST_WORDS = 100_000  # words of a step's selectors, some hundred bytes each


def _matches(active: DataFrame, here: DataFrame, nodes: DataFrame, longest: int, words: int, scratch: Scratch, name: str) -> DataFrame:
    """Nodes matching each active selector on its pages: ``page_id, rule_id, _to, _to_last``."""
    wanted = active.select("page_id", "rule_id", "parts").dropDuplicates(["page_id", "rule_id"])
    wanted = wanted.select("page_id", "rule_id", F.size("parts").alias("_len"), F.posexplode("parts").alias("_j", "_part"))
    wanted = wanted.withColumn("_token", _part_token(F.col("_part")))
    # Elements no rule of this step could look up are dropped before anything moves.
    # The tokens in use are as few as the rules' words, whatever the pages hold; they were
    # counted, so that a set too large to be sent around is joined by sorting.
    used = here.filter(F.col("parts").isNotNull()).select(F.explode(F.transform("parts", _part_token)).alias("_token")).distinct()
    known = nodes.select("page_id", F.col("node_id").alias("_to"), F.col("last_desc").alias("_to_last"), "tag", "attrs", "type_ix", F.explode(_tokens()).alias("_token"))
    known = known.join(F.broadcast(used) if words <= BROADCAST_WORDS else used, "_token", "left_semi")
    hits = known.join(wanted, ["page_id", "_token"]).filter(_part_holds(F.col("_part")))
    hits = hits.select("page_id", "rule_id", "_to", "_to_last", "_j", "_len")
    if longest > 1:
        # Each level below reads the hits again.
        hits = scratch.keep(hits, f"hits-{name}")
    level = hits.filter(F.col("_j") == 0)
    done = [level.filter(F.col("_len") == 1)]
    for j in range(1, longest):
        above = level.select("page_id", "rule_id", F.col("_to").alias("_up"), F.col("_to_last").alias("_up_last"))
        level = inside(above, hits.filter(F.col("_j") == j), ["page_id", "rule_id"], "_up", "_up_last", "_to", "left_semi", itself=False)
        done.append(level.filter(F.col("_len") == j + 1))
    return reduce(DataFrame.unionByName, done).select("page_id", "rule_id", "_to", "_to_last")


def _found(active: DataFrame, here: DataFrame, nodes: DataFrame, longest: int, words: int, in_container: bool, scratch: Scratch, name: str) -> DataFrame:
    """Matches inside each frontier node; ``src`` is the node they were found in."""
    matched = _matches(active, here, nodes, longest, words, scratch, name)
    found = inside(active.withColumnRenamed("node_id", "src"), matched, ["page_id", "rule_id"], "src", "last", "_to")
    if in_container:
        return found
    is_self = F.col("_to") == F.col("src")
    w = Window.partitionBy("page_id", "rule_id", "src", "ctx")
    found = found.withColumn("_own", F.max(is_self & F.col("simple")).over(w))
    return found.filter((F.col("_own") & is_self) | (~F.col("_own") & ~is_self)).drop("_own")


def run_rules(nodes: DataFrame, start: DataFrame, steps: DataFrame, in_container: bool = False) -> DataFrame:
    """Run every rule of ``start`` to its end.

    ``start`` is a frontier (``rule_id`` names the rule each row runs).
    Returns ``FRONTIER + op, arg``: the selected nodes and what to extract.
    ``in_container`` starts rules inside list containers, where the container
    counts as part of the searched fragment.
    """
    with Scratch(nodes.sparkSession) as scratch, joining_in_place(nodes.sparkSession):
        return materialize(_run(nodes, start, steps, in_container, scratch), "selected")


def _run(nodes: DataFrame, start: DataFrame, steps: DataFrame, in_container: bool, scratch: Scratch) -> DataFrame:
    # Every step reads these again: written once, they also have a known size, so
    # Catalyst may broadcast a small rule set and will not broadcast a large one.
    steps, frontier = scratch.keep(steps, "steps"), scratch.keep(with_last(start.select(FRONTIER), nodes), "start")
    parts = F.coalesce(F.size("parts"), F.lit(0))
    used = steps.groupBy("step_no", "op").agg(F.max(parts).alias("longest"), F.sum(parts).alias("words")).collect()
    last = max((r["step_no"] for r in used), default=-1)
    finished = []
    for k in range(last + 2):
        here = steps.filter(F.col("step_no") == k).drop("step_no")
        cur = frontier.join(here, "rule_id", "left")
        ends = F.col("op").isNull() | F.col("op").isin(TERMINAL)
        finished.append(cur.filter(ends).select(
            *FRONTIER, F.coalesce("op", F.lit("text")).alias("op"), F.coalesce("arg", F.lit("")).alias("arg")))
        ops = {r["op"]: r["longest"] for r in used if r["step_no"] == k and r["op"] not in TERMINAL}
        if not ops:
            break
        moved = []
        first = in_container and k == 0
        there = [*KEYS, F.col("_to").alias("node_id"), F.array_append("ord", F.col("_to")).alias("ord"), F.col("_to_last").alias("last")]
        to = [F.col("node_id").alias("_to"), F.col("last_desc").alias("_to_last")]
        chosen = [op for op in ("select", "indexed") if op in ops]
        if chosen:
            act = cur.filter(F.col("op").isin(chosen) & (F.trim("arg") != ""))
            words = sum(r["words"] for r in used if r["step_no"] == k)
            hit = _found(act, here, nodes, max(ops[op] for op in chosen), words, first, scratch, f"select{k}")
            if "indexed" in ops:
                w = Window.partitionBy("page_id", "rule_id", "src", "ctx").orderBy("_to")
                hit = hit.withColumn("_rn", F.row_number().over(w)).filter((F.col("op") == "select") | (F.col("_rn") == F.col("n") + 1))
            moved.append(hit.select(there))
            # An empty selector stays where it is: the document or the container.
            moved.append(cur.filter((F.col("op") == "select") & (F.trim("arg") == "")).select(RUNNING))
        family = [op for op in ("all", "children", "child") if op in ops]
        if family:
            act = cur.filter(F.col("op").isin(family))
            kids = nodes.select("page_id", F.col("parent_id").alias("node_id"), *to, "sib_ix")
            down = act.join(kids, ["page_id", "node_id"]).filter((F.col("op") != "child") | (F.col("sib_ix") == F.col("n")))
            # "all" at the end of a rule only means "every match".
            following = steps.filter(F.col("step_no") == k + 1).select("rule_id", F.lit(True).alias("_goes_on")).distinct()
            down = down.join(following, "rule_id", "left").filter((F.col("op") != "all") | F.col("_goes_on"))
            moved.append(down.select(there))
            moved.append(act.filter(F.col("op") == "all").select(*KEYS, "node_id", F.array_append("ord", F.col("node_id")).alias("ord"), "last"))
        if "parent" in ops:
            up = nodes.select("page_id", "node_id", F.col("parent_id").alias("_to")).filter(F.col("_to").isNotNull())
            hit = cur.filter(F.col("op") == "parent").join(up, ["page_id", "node_id"])
            moved.append(hit.join(nodes.select("page_id", *to), ["page_id", "_to"]).select(there))
        if "next" in ops or "prev" in ops:
            at = nodes.select("page_id", "node_id", "parent_id", "sib_ix")
            hit = cur.filter(F.col("op").isin("next", "prev")).join(at, ["page_id", "node_id"])
            hit = hit.withColumn("sib_ix", F.col("sib_ix") + F.when(F.col("op") == "next", 1).otherwise(-1))
            moved.append(hit.join(nodes.select("page_id", "parent_id", "sib_ix", *to), ["page_id", "parent_id", "sib_ix"]).select(there))
        if "text_match" in ops:
            act = cur.filter(F.col("op") == "text_match")
            moved.append(best_text_matches(act, text_candidates(nodes, act.select("page_id", "arg").distinct())))
        step = reduce(DataFrame.unionByName, moved).groupBy(*KEYS, "node_id").agg(F.min("ord").alias("ord"), F.any_value("last").alias("last")).select(RUNNING)
        frontier = scratch.keep(step, f"frontier{k}")
    return reduce(DataFrame.unionByName, finished)


def rule_values(results: DataFrame, nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The strings a run selected: ``KEYS, ord, value``.

    The text and source of a page are joined only for rules that ask for them.
    """
    ops = {r[0] for r in results.select("op").distinct().collect()}  # a handful of words
    none = results.filter(F.lit(False)).select(*FRONTIER, F.lit("").alias("value"))
    at = nodes.select("page_id", "node_id", "attrs", "t_from", "t_to", "src_from", "src_to", "in_from", "in_to")
    rows = results.join(at, ["page_id", "node_id"])
    parts = []
    if "attr" in ops:
        parts.append(rows.filter(F.col("op") == "attr").withColumn("value", F.coalesce(F.col("attrs")[F.col("arg")], F.lit(""))))
    if "text" in ops:
        text = rows.filter(F.col("op") == "text").join(page_texts(nodes), "page_id")
        parts.append(text.withColumn("value", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text"))))
    markup_ops = ops & {"html", "outer_html", "own_text"}
    if markup_ops and pages is None:
        raise ValueError("markup rules need the pages table")
    if markup_ops:
        outer = F.col("op") == "outer_html"
        a = F.when(outer, F.col("src_from")).otherwise(F.col("in_from"))
        b = F.when(outer, F.col("src_to")).otherwise(F.col("in_to"))
        raw = pages.select("page_id", F.col("html").cast("binary").alias("_html"))
        markup = rows.filter(F.col("op").isin(*markup_ops)).join(raw, "page_id")
        cut = F.substring("_html", a + 1, b - a).cast("string")
        parts.append(markup.withColumn("value", F.when(F.col("op") == "own_text", html_to_text(cut)).otherwise(cut)))
    return reduce(DataFrame.unionByName, [p.select(*FRONTIER, "value") for p in parts], none)
