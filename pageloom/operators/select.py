"""Element selection as joins over the node table.

A frontier is ``page_id, rule_id, ctx, node_id, ord``. ``ord`` is the path of
node numbers a result was reached by; comparing paths gives the order of the
result list without numbering rows. Containment is an interval join over blocks of node
numbers (:mod:`pageloom.operators.within`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import clean_text, html_to_text
from pageloom.operators.nodes import page_texts
from pageloom.operators.within import inside

# --- fixed values -----------------------------------------------------------
SELECTOR_TAGS = (
    "a abbr article aside audio b body br button canvas caption cite code col dd div dl dt em embed fieldset figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link meta nav ol option p picture "
    "pre script section select small source span strong table tbody td textarea tfoot th thead time title tr ul video "
    "main style"
).split()
STEP_WORDS = {
    "all": "all", "each": "all", "children": "children", "next": "next", "prev": "prev", "parent": "parent",
    "Text": "text", "text": "text", "textNodes": "text", "TextNodes": "text", "ownText": "own_text",
    "OwnText": "own_text", "Html": "html", "html": "html", "innerHtml": "html", "outerHtml": "outer_html",
    "OuterHtml": "outer_html", "removeHtml": "own_text", "RemoveHtml": "own_text",
}
TERMINAL = ["attr", "text", "own_text", "html", "outer_html"]
# ---------------------------------------------------------------------------

# The grammar of rules, for expressions and for single rules alike: the first form a
# token has names its operator, and the form's group is the argument.
STEP_MARK, NUMBER, NUMBERED = r"(?<!\\)@", r"\.([0-9]+)$", ["indexed", "child"]
_XPATH = r"(?=//|\./|.*\[@|.*text\(\)$)"
FIRST_FORMS = [("xpath_text", rf"(?s)^{_XPATH}(?=.*text\(\))(.*)$"), ("xpath", rf"(?s)^{_XPATH}(.*)$"), ("select", r"(?s)^(.*)$")]
LATER_FORMS = [
    *[(op, rf"^{word}()$") for word, op in STEP_WORDS.items()],
    ("child", r"^child\.()"),
    ("text", rf"(?s)^{_XPATH}(?=.*text\(\))()"),
    ("xpath", rf"(?s)^{_XPATH}(.*)$"),
    ("indexed", r"(?s)^(.*\S.*)\.[0-9]+$"),
    ("select", r"(?s)^((?:tag|id|class)\..*)$"),
    ("text_match", r"(?s)^text\.\s*(.*)$"),
    ("select", rf"(?i)^({'|'.join(SELECTOR_TAGS)})$"),
    ("attr", r"(?s)^(.*)$"),
]
# What selectors and the segments of an XPath are rewritten by, one after the other.
PREFIXES = [(r"^class\.", "."), (r"^id\.", "#"), (r"^tag\.", "")]
XPATH_TAIL, XPATH_SKIPPED = r"(?s)/*\s*(text\(\).*)?$", ["", ".", ".."]
XPATH_SEGMENT = [
    (r"(\[[^\]]*)$", "$1]"), (r"\[\s*0*([0-9]+)\s*\]", ":nth-of-type($1)"), (r":nth-of-type\(0\)", ":nth-of-type(1)"),
    (r"\[\s*@\s*", "["), (r"\s*=\s*", "="), (r"\s+\]", "]")]

KEYS = ["page_id", "rule_id", "ctx"]
FRONTIER = [*KEYS, "node_id", "ord"]


# --- selectors in rule text ----------------------------------------------------


@dataclass
class Part:
    """One compound of a selector: ``div.card[data-x='1']``."""

    tag: str = ""
    id: str = ""
    classes: list[str] = field(default_factory=list)
    attr: str = ""
    value: str | None = None
    nth: int = 0


_PIECE = re.compile(
    r"(?P<tag>^[A-Za-z][\w-]*|^\*)|\.(?P<cls>[^.#\[:\s]+)|#(?P<id>[^.#\[:\s]+)"
    r"|\[(?P<attr>[\w:-]+)(?:=['\"]?(?P<val>[^'\"\]]*)['\"]?)?\]|:nth-of-type\((?P<nth>\d+)\)"
)


def parse_selector(selector: str) -> list[Part] | None:
    """Compounds of a selector, outermost first; ``None`` when it is malformed."""
    text = to_css(selector)
    parts = []
    for word in text.split():
        part, at = Part(), 0
        while at < len(word):
            m = _PIECE.match(word, at) if at else _PIECE.match(word)
            if not m:
                return None
            if m["tag"] is not None:
                part.tag = "" if m["tag"] == "*" else m["tag"].lower()
            elif m["cls"] is not None:
                if m["cls"][0].isdigit():
                    return None
                part.classes.append(m["cls"])
            elif m["id"] is not None:
                part.id = m["id"]
            elif m["attr"] is not None:
                part.attr, part.value = m["attr"], m["val"]
            else:
                part.nth = int(m["nth"])
            at = m.end()
        parts.append(part)
    return parts


def replaced(text: str, table: list[tuple[str, str]]) -> str:
    """A table of replacements, as the expressions of ``rulesets`` apply them, on a string."""
    for pattern, by in table:
        text = re.sub(pattern, by.replace("$1", r"\1"), text)
    return text


def to_css(token: str) -> str:
    return replaced(token.strip(), PREFIXES).strip() or "*"


def is_simple(selector: str) -> bool:
    """Selectors an element may satisfy on its own: tag, class, id, or all."""
    return not re.search(r"[\s\[:]", to_css(selector))


def xpath_selector(xpath: str) -> str:
    """The selector an XPath stands for."""
    segments = [x.strip() for x in re.sub(XPATH_TAIL, "", xpath).split("/")]
    return " ".join(replaced(x, XPATH_SEGMENT) for x in segments if x not in XPATH_SKIPPED)


# --- C2 --------------------------------------------------------------------------


def compile_rules(rules: DataFrame) -> DataFrame:
    """Rule strings to ``rule_id, step_no, op, arg, n``.

    Step 0 selects from the document root; ``\\@`` is a literal at sign. Input
    columns: ``rule_id, rule``.
    """
    tokens = F.split(F.trim(F.col("rule")), STEP_MARK)
    steps = rules.select("rule_id", F.posexplode(tokens).alias("step_no", "raw"))
    steps = steps.withColumn("tok", F.trim(F.replace(F.col("raw"), F.lit(r"\@"), F.lit("@"))))
    tok, first = F.col("tok"), F.col("step_no") == 0

    def chosen(value) -> Column:
        """What the first form says that the token has."""
        by = lambda forms: F.coalesce(*[F.when(tok.rlike(pattern), value(op, pattern)) for op, pattern in forms])
        return F.when(first, by(FIRST_FORMS)).otherwise(by(LATER_FORMS))

    steps = steps.withColumn("op", chosen(lambda op, _: F.lit(op)))
    arg = chosen(lambda _, pattern: F.regexp_extract(tok, pattern, 1))
    number = F.regexp_extract(tok, NUMBER, 1).try_cast("int")
    n = F.when(F.col("op").isin(NUMBERED), F.coalesce(number, F.lit(0))).otherwise(F.lit(0))
    return steps.select("rule_id", "step_no", "op", arg.alias("arg"), n.alias("n"))


def split_rule(rule: str) -> list[tuple[str, str, int]]:
    """The same for one rule while a plan is built, XPath translated: ``[(op, arg, n), …]``."""
    out: list[tuple[str, str, int]] = []
    for i, raw in enumerate(re.split(STEP_MARK, rule.strip())):
        tok = raw.replace("\\@", "@").strip()
        op, found = next((op, m) for op, pattern in (LATER_FORMS if i else FIRST_FORMS) if (m := re.search(pattern, tok)))
        number = re.search(NUMBER, tok) if op in NUMBERED else None
        if op.startswith("xpath"):
            out.append(("select", xpath_selector(found[1]), 0))
            out += [("text", "", 0)] * (op == "xpath_text")
        else:
            out.append((op, found[1], int(number[1]) if number else 0))
    return out


# --- C3 --------------------------------------------------------------------------


def class_list(attrs: Column) -> Column:
    return F.split(F.coalesce(attrs["class"], F.lit("")), r"[ \t\n\f\r]+")


def match_part(part: Part) -> Column:
    """Does an element row satisfy one compound?"""
    out = F.lit(True)
    attrs = F.col("attrs")
    if part.tag:
        out = out & (F.col("tag") == part.tag)
    for name in part.classes:
        out = out & F.array_contains(class_list(attrs), name)
    if part.id:
        out = out & (F.coalesce(attrs["id"], F.lit("")) == part.id)
    if part.attr:
        out = out & (attrs[part.attr].isNotNull() if part.value is None else F.coalesce(attrs[part.attr] == part.value, F.lit(False)))
    if part.nth:
        out = out & (F.col("type_ix") == part.nth)
    return out


def match_simple(selector: str) -> Column:
    """C3 for a single compound given as rule text."""
    parts = parse_selector(selector)
    return match_part(parts[-1]) if parts else F.lit(False)


def match_selector(nodes: DataFrame, selector: str) -> DataFrame:
    """All nodes a selector matches, wherever they are: ``page_id, node_id, last_desc``.

    A compound after a blank needs an ancestor that the compounds before it match.
    """
    parts = parse_selector(selector)
    if parts is None:
        return nodes.filter(F.lit(False)).select("page_id", "node_id", "last_desc")
    out = None
    for part in parts:
        hits = nodes.filter(match_part(part)).select("page_id", "node_id", "last_desc")
        if out is not None:
            above = out.select("page_id", F.col("node_id").alias("_up"), F.col("last_desc").alias("_up_last"))
            hits = inside(above, hits, ["page_id"], "_up", "_up_last", "node_id", "left_semi", itself=False)
        out = hits
    return out


# --- frontiers -------------------------------------------------------------------


def roots(nodes: DataFrame, rule_id: str = "") -> DataFrame:
    """The document element of every page as a frontier."""
    return nodes.filter(F.col("node_id") == 0).select(
        "page_id", F.lit(rule_id).alias("rule_id"), F.lit(0).alias("ctx"), "node_id",
        F.array().cast("array<int>").alias("ord"))


def dedup_nodes(f: DataFrame) -> DataFrame:
    """C14: each node once, at its first position."""
    return f.groupBy(*KEYS, "node_id").agg(F.min("ord").alias("ord")).select(FRONTIER)


def with_last(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """Frontier rows with ``last``, the number of their node's last descendant."""
    return f.join(nodes.select("page_id", "node_id", F.col("last_desc").alias("last")), ["page_id", "node_id"])


def _within(frontier: DataFrame, nodes: DataFrame, selector: str) -> DataFrame:
    """Matches inside each frontier node, with ``src`` the node they were found in."""
    simple = is_simple(selector)
    matched = match_selector(nodes, selector).select("page_id", "node_id")
    f = with_last(frontier, nodes).withColumnRenamed("node_id", "src")
    found = inside(f, matched, ["page_id"], "src", "last", "node_id", itself=simple)
    if simple:
        # A frontier node that matches keeps itself and is not descended into.
        w = Window.partitionBy("page_id", "src", "rule_id", "ctx")
        own = F.max(F.col("node_id") == F.col("src")).over(w)
        found = found.withColumn("_own", own).filter(~F.col("_own") | (F.col("node_id") == F.col("src"))).drop("_own")
    return found


def select_within(frontier: DataFrame, nodes: DataFrame, selector: str) -> DataFrame:
    """C4: descendants matching a selector, or the frontier node itself when it matches."""
    found = _within(frontier, nodes, selector)
    return dedup_nodes(found.withColumn("ord", F.array_append("ord", F.col("node_id"))))


def select_path(frontier: DataFrame, nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """A chain of C4 steps."""
    for selector in selectors:
        frontier = select_within(frontier, nodes, selector)
    return frontier


def children(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """Element children."""
    kids = nodes.select("page_id", F.col("parent_id").alias("_up"), F.col("node_id").alias("_kid"))
    out = f.withColumnRenamed("node_id", "_up").join(kids, ["page_id", "_up"])
    return out.withColumn("node_id", F.col("_kid")).withColumn("ord", F.array_append("ord", F.col("_kid"))).select(FRONTIER)


def child_at(f: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The child element at position ``n``, counted from 0."""
    return children(f, nodes.filter(F.col("sib_ix") == n))


def sibling(f: DataFrame, nodes: DataFrame, delta: int) -> DataFrame:
    """The next (+1) or previous (-1) sibling element."""
    here = nodes.select("page_id", "node_id", "parent_id", (F.col("sib_ix") + delta).alias("_at"))
    there = nodes.select("page_id", "parent_id", F.col("sib_ix").alias("_at"), F.col("node_id").alias("_to"))
    out = f.join(here, ["page_id", "node_id"]).join(there, ["page_id", "parent_id", "_at"])
    return _moved(out)


def parent_of(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """The parent element; the root has none."""
    up = nodes.select("page_id", "node_id", F.col("parent_id").alias("_to")).filter(F.col("_to").isNotNull())
    return _moved(f.join(up, ["page_id", "node_id"]))


def _moved(out: DataFrame) -> DataFrame:
    return out.select(*KEYS, F.col("_to").alias("node_id"), F.array_append("ord", F.col("_to")).alias("ord"))


def indexed(f: DataFrame, nodes: DataFrame, selector: str, n: int) -> DataFrame:
    """C11: the n-th match (from 0) inside each frontier node."""
    w = Window.partitionBy("page_id", "src", "rule_id", "ctx").orderBy("node_id")
    hits = _within(f, nodes, selector).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == n + 1)
    return hits.withColumn("ord", F.array_append("ord", F.col("node_id"))).select(FRONTIER)


def node_text(t_from: Column, t_to: Column, doc_text: Column) -> Column:
    return clean_text(F.substring(doc_text, t_from + 1, t_to - t_from).cast("string"))


def with_text(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """Frontier rows plus ``text``, white space squeezed."""
    at = nodes.select("page_id", "node_id", "t_from", "t_to")
    out = f.join(at, ["page_id", "node_id"]).join(page_texts(nodes), "page_id")
    return out.withColumn("text", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text"))).drop("t_from", "t_to", "doc_text")


def text_candidates(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Nodes whose text contains a wanted text: ``page_id, arg, node_id, last_desc, text``.

    ``wanted``: ``page_id, arg``. A node's text is a stretch of its page's, so pages
    without the wanted text drop out before their nodes are looked at.
    """
    holds = clean_text(F.col("doc_text").cast("string")).contains(F.col("arg"))
    pages = wanted.join(page_texts(nodes), "page_id").filter(holds)
    rows = nodes.select("page_id", "node_id", "last_desc", "t_from", "t_to").join(pages, "page_id")
    rows = rows.withColumn("text", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text")))
    return rows.filter(F.col("text").contains(F.col("arg"))).select("page_id", "arg", "node_id", "last_desc", "text")


def best_text_matches(active: DataFrame, candidates: DataFrame) -> DataFrame:
    """C12 for frontier rows that carry ``last`` and the text they want in ``arg``; with ``last`` of the matches."""
    offered = candidates.select("page_id", "arg", "text", F.col("node_id").alias("_to"), F.col("last_desc").alias("_to_last"))
    pool = inside(active.select(*FRONTIER, "last", "arg"), offered, ["page_id", "arg"], "node_id", "last", "_to")
    pool = pool.groupBy(*KEYS, "arg", "_to").agg(
        F.min(F.array_append("ord", F.col("_to"))).alias("ord"), F.max(F.col("_to") == F.col("node_id")).alias("_self"),
        F.any_value("text").alias("text"), F.any_value("_to_last").alias("_to_last"))
    exact = F.col("text") == F.col("arg")
    rank = F.when(exact & F.col("_self"), 0).when(exact, 1).otherwise(2)
    best = F.min("_rank").over(Window.partitionBy(*KEYS))
    hits = pool.withColumn("_rank", rank).withColumn("_best", best).filter(F.col("_rank") == F.col("_best"))
    # In the order of node numbers, an element that holds a match holds the next one.
    following = F.lead("_to").over(Window.partitionBy(*KEYS).orderBy("_to"))
    hits = hits.withColumn("_holds", F.coalesce(following <= F.col("_to_last"), F.lit(False)))
    return hits.filter((F.col("_rank") < 2) | ~F.col("_holds")).select(
        *KEYS, F.col("_to").alias("node_id"), "ord", F.col("_to_last").alias("last"))


def text_match(f: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose text is ``text``: in the frontier, else below it, else the
    deepest nodes that contain it."""
    active = with_last(f, nodes).withColumn("arg", F.lit(text.strip()))
    return best_text_matches(active, text_candidates(nodes, active.select("page_id", "arg").distinct())).select(FRONTIER)


def each(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every frontier node followed by its children."""
    here = f.withColumn("ord", F.array_append("ord", F.col("node_id")))
    return dedup_nodes(here.select(FRONTIER).unionByName(children(f, nodes)))


def root_fallback(nodes: DataFrame, selector: str, rule_id: str = "") -> DataFrame:
    """Start of a rule. No selector starts at the document; a selector that
    matches nothing stays empty."""
    start = roots(nodes, rule_id)
    return start if not selector.strip() else select_within(start, nodes, selector)


# --- values ------------------------------------------------------------------------


def extract_attr(f: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """Attribute values; a missing one is ``''`` so positions stay aligned."""
    at = nodes.select("page_id", "node_id", F.coalesce(F.col("attrs")[name], F.lit("")).alias("value"))
    return dedup_nodes(f).join(at, ["page_id", "node_id"])


def extract_text(f: DataFrame, nodes: DataFrame) -> DataFrame:
    """C17: visible text."""
    return with_text(dedup_nodes(f), nodes).withColumnRenamed("text", "value")


def extract_html(f: DataFrame, nodes: DataFrame, pages: DataFrame, outer: bool = True) -> DataFrame:
    """The source markup of each node, with or without its own tags."""
    a, b = ("src_from", "src_to") if outer else ("in_from", "in_to")
    at = nodes.select("page_id", "node_id", F.col(a).alias("_a"), F.col(b).alias("_b"))
    raw = pages.select("page_id", F.col("html").cast("binary").alias("_html"))
    out = dedup_nodes(f).join(at, ["page_id", "node_id"]).join(raw, "page_id")
    cut = F.substring(F.col("_html"), F.col("_a") + 1, F.col("_b") - F.col("_a")).cast("string")
    return out.withColumn("value", cut).drop("_a", "_b", "_html")


def extract_own_text(f: DataFrame, nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Inner markup with tags stripped, line structure kept."""
    return extract_html(f, nodes, pages, outer=False).withColumn("value", html_to_text(F.col("value")))


def links_by_text(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """C20: per page the first real link whose text contains one of the labels."""
    anchors = nodes.filter((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull())
    href = F.col("attrs")["href"]
    real = (F.trim(href) != "") & ~href.startswith("javascript")
    a = anchors.filter(real).select("page_id", "node_id", href.alias("href"), "t_from", "t_to").join(page_texts(nodes), "page_id")
    a = a.withColumn("text", F.lower(node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text"))))
    hit = F.exists(F.array(*[F.lit(x.lower()) for x in labels]), lambda x: F.col("text").contains(x))
    return a.filter(hit).groupBy("page_id").agg(F.min_by("href", "node_id").alias("href"))


# --- whole rules -------------------------------------------------------------------


def walk(frontier: DataFrame, nodes: DataFrame, steps: list[tuple[str, str, int]]) -> tuple[DataFrame, tuple[str, str]]:
    """Apply compiled steps; returns the last frontier and what to extract."""
    for i, (op, arg, n) in enumerate(steps):
        if op in TERMINAL:
            return frontier, (op, arg)
        if op == "select":
            frontier = select_within(frontier, nodes, arg)
        elif op == "indexed":
            frontier = indexed(frontier, nodes, arg, n)
        elif op == "all":
            frontier = each(frontier, nodes) if i + 1 < len(steps) else frontier
        elif op == "children":
            frontier = children(frontier, nodes)
        elif op == "child":
            frontier = child_at(frontier, nodes, n)
        elif op in ("next", "prev"):
            frontier = sibling(frontier, nodes, 1 if op == "next" else -1)
        elif op == "parent":
            frontier = parent_of(frontier, nodes)
        elif op == "text_match":
            frontier = text_match(frontier, nodes, arg)
    return frontier, ("text", "")


def select_nodes(nodes: DataFrame, rule: str, start: DataFrame | None = None, rule_id: str = "") -> DataFrame:
    """The nodes one rule selects, from the document or inside given containers."""
    steps = split_rule(rule)
    start = roots(nodes, rule_id) if start is None else start
    if steps[0] == ("select", "", 0):
        steps = steps[1:]
    return walk(start, nodes, steps)[0]


def select(nodes: DataFrame, rule: str, pages: DataFrame | None = None, start: DataFrame | None = None,
           rule_id: str = "") -> DataFrame:
    """One rule evaluated to ``…, ord, value`` rows."""
    steps = split_rule(rule)
    start = roots(nodes, rule_id) if start is None else start
    if steps[0] == ("select", "", 0):
        steps = steps[1:]
    frontier, (op, arg) = walk(start, nodes, steps)
    if op == "attr":
        return extract_attr(frontier, nodes, arg)
    if op == "text":
        return extract_text(frontier, nodes)
    if pages is None:
        raise ValueError("markup rules need the pages table")
    if op == "own_text":
        return extract_own_text(frontier, nodes, pages)
    return extract_html(frontier, nodes, pages, outer=op == "outer_html")
