import random
import time
import tracemalloc

from pyspark.sql import functions as F

from pageloom.operators import select as sel
from pageloom.operators.nodes import page_rows, shred_pages
from pageloom.operators.within import inside


def tree(rng, n):
    """Random trees as (node, last descendant), numbered in document order."""
    parent = [None] + [rng.randint(max(0, i - rng.choice([1, 3, 200])), i - 1) for i in range(1, n)]
    kids = [[] for _ in range(n)]
    for i, p in enumerate(parent):
        if p is not None:
            kids[p].append(i)
    number, out, stack = {}, [], [(0, False)]
    while stack:
        i, left = stack.pop()
        if left:
            out[number[i]] = (number[i], len(number) - 1)
            continue
        number[i] = len(number)
        out.append(None)
        stack.append((i, True))
        stack += [(k, False) for k in reversed(kids[i])]
    return out


def test_inside_against_all_pairs(spark):
    rng = random.Random(4)
    nodes = [(page, a, b) for page, n in ((1, 500), (2, 30), (3, 1)) for a, b in tree(rng, n)]
    outer = [x for x in nodes if rng.random() < 0.4]
    inner = [(p, a) for p, a, _ in nodes if rng.random() < 0.5]
    left = spark.createDataFrame(outer, "page_id int, a int, b int")
    right = spark.createDataFrame(inner, "page_id int, at int")
    for itself in (True, False):
        want = {(p, at, a) for p, at in inner for q, a, b in outer if p == q and a + (not itself) <= at <= b}
        assert {(r["page_id"], r["at"], r["a"]) for r in inside(left, right, ["page_id"], "a", "b", "at", itself=itself).collect()} == want
        semi = inside(left, right, ["page_id"], "a", "b", "at", "left_semi", itself=itself)
        assert semi.columns == right.columns
        assert sorted((r["page_id"], r["at"]) for r in semi.collect()) == sorted({(p, at) for p, at, _ in want})


def test_deep_pages_take_linear_time_and_memory():
    def cost(n):
        html = "<div><b>" * n + "<p>x<p>y</em></table>" * 100
        tracemalloc.start()
        start, count = time.perf_counter(), sum(1 for _ in page_rows(1, html))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert count == 2 * n + 202
        return time.perf_counter() - start, peak

    cost(100)
    (t1, m1), (t2, m2) = cost(5_000), cost(20_000)
    assert m2 < 5 * m1 and t2 < 12 * t1


def test_selection_in_a_deep_page(spark):
    html = "".join(f"<div class=c{i % 50}>" for i in range(3000)) + "<a href=/x>deep</a>"
    nodes = shred_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert [r["value"] for r in sel.select(nodes, ".c49@a@href").collect()] == ["/x"]
    assert nodes.filter("depth > 3000").count() == 2
    found = sel.select(nodes, ".c7 .c8 a@text").select(F.count("*").alias("n")).first()
    assert found.n == 1


def test_a_run_reads_bucketed_nodes_where_they_lie(spark, tmp_path, monkeypatch):
    """No plan of a run shuffles the node table; only the run's own rows move."""
    from pageloom import session
    from pageloom.operators.rulesets import plan_steps, run_rules
    from pageloom.sources.tables import save_nodes

    html = "<ul>" + "<li><a href=/x>t</a><b>u</b></li>" * 4 + "</ul>"
    pages = spark.createDataFrame([(i, "u", html) for i in range(40)], "page_id long, url string, html string")
    nodes = save_nodes(shred_pages(pages), "bucketed_nodes", str(tmp_path / "nodes"), 4)
    plans = []
    keep = session.Scratch.keep

    def seen(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(self, df, name)

    monkeypatch.setattr(session.Scratch, "keep", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the run's rows were many
    try:
        rules = ["ul@li@a@href", "ul@children@a.0@text", "ul li@next@b", "ul@child.1@parent@li"]
        start = nodes.filter("node_id = 0").select("page_id", F.explode(F.array(*map(F.lit, rules))).alias("rule_id"), F.lit(0).alias("ctx"),
                                                   "node_id", F.array().cast("array<int>").alias("ord"))
        got = run_rules(nodes, start, plan_steps(spark.createDataFrame([(r, r) for r in rules], "rule_id string, rule string")))
        assert got.groupBy("rule_id").count().count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_nodes")
    reading = [p for _, p in plans if "bucketed_nodes" in p]
    assert len(reading) >= 3
    for plan in reading:
        lines = plan.split("\n")
        for k, line in enumerate(lines):
            if "Scan parquet" in line and "bucketed_nodes" in line:
                # Up the tree from the scan to the first join: no exchange but one for a broadcast or a token lookup.
                depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
                for above in reversed(lines[:k]):
                    d = len(above) - len(above.lstrip(" :+-*()0123456789"))
                    if d >= depth:
                        continue
                    depth = d
                    if "Join" in above:
                        break
                    assert "Exchange" not in above, plan
