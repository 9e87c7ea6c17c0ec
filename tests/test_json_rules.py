import json

from pyspark.sql import functions as F

from pageloom.functions import jsonpath as j
from pageloom.functions import rules as r

CRATES = {"unit": "kg", "crates": [{"fruit": {"kind": "pear", "unit": "g"}}, {"fruit": {"kind": "plum"}}]}


def v(value):
    return F.parse_json(F.lit(value if isinstance(value, str) else json.dumps(value)))


def test_paths(one):
    assert one(j.json_path(v(CRATES), "$.crates[0].fruit.kind")) == ["pear"]
    assert one(j.json_path(v(CRATES), "crates.fruit.kind")) == ["pear", "plum"]
    assert one(j.json_path(v(CRATES), "$['crates'][*]['fruit'].kind")) == ["pear", "plum"]
    assert one(j.json_path(v(CRATES), "$.none")) == []
    assert one(j.json_path(v({"a": [1, None, True, {"b": 1}]}), "$.a[*]")) == ["1", "", "true", '{"b":1}']
    assert j.path_steps("$.a[?(") is None


def test_descent_reaches_every_level(spark):
    df = spark.createDataFrame([(1, json.dumps(CRATES)), (2, '{"a":{"b":[[{"unit":"x"}]]}}'), (3, "no json")], "id int, body string")
    rows = [(x["id"], x["text"]) for x in j.json_descend(df, "unit").orderBy("id", "text").collect()]
    assert rows == [(1, "g"), (1, "kg"), (2, "x")]


def test_descent_is_not_stopped_by_depth_or_by_texts_that_only_look_nested(spark):
    deep = "x"
    for _ in range(30):
        deep = {"a": deep, "k": 1}
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, "[" * 5000)], "id int, body string")
    assert j.json_descend(df, "k").count() == 30


def test_branches():
    assert j.split_branches("$.a||$.b.c || $.d") == ["$.a", "$.b.c", "$.d"]
    assert j.split_branches("{{$.a || 'x'}}||'p||q'") == ["{{$.a || 'x'}}", "'p||q'"]


def test_first_branch_with_text_wins_and_nothing_is_invented(one):
    body = {"head": " ", "parts": {"lead": {"line": "t"}}}
    assert one(j.json_first_of(v(body), "$.head||$.parts.lead.line||$.line")) == "t"
    assert one(j.json_first_of(v(body), "$.x||$.y")) == ""


def test_steps(one):
    values = F.array(v([{"n": 1}, {"n": 2}, {"n": 3}]))
    assert one(j.json_steps(values, [("child", "0"), ("next", ""), ("attr", "n")])) == ["2", "3"]
    assert one(j.json_steps(values, [("all", ""), ("prev", ""), ("attr", "n")])) == ["2", "1"]


def test_lists_are_inferred(spark):
    bodies = [(1, '{"list":[],"data":[1]}'), (2, '{"z":{"rows2":[{"a":1}]},"b":{"c":{"d":[{}]}}}'), (3, '{"x":1}'), (4, "[[{}]]")]
    df = spark.createDataFrame(bodies, "id int, body string")
    assert {x["id"]: x["rule"] for x in j.infer_json_list(df, "id").collect()} == {1: "$.data", 2: "$.d", 3: "", 4: ""}


def test_nesting_of_long_strings(spark):
    deep = '{"a":"' + '\\"[{' * 20_000 + '","b":[{"c":[1]}]}'
    assert spark.createDataFrame([(deep,)], "b string").select(j.nesting(F.col("b"))).first()[0] == 4


def test_verdicts(one):
    check = lambda body, path: one(j.lookup_verdict(j.json_path(v(body), path), F.lit(j.path_steps(path) is not None)))
    assert check({"a": 1}, "$.b") == "no_match" and check({"a": ""}, "$.a") == "empty_values"
    assert check({"a": 1}, "$.a") == "values" and check({"a": 1}, "$.a[?(") == "bad_path"


def test_templates(one):
    row = {"no": 7, "shelf": 3, "due": "2024-01-01 noon"}
    assert one(r.render_template(v(row), "/v/{{$.shelf}}/{{ no }}?t={{$.due## .*##}}&x={{none}}")) == "/v/3/7?t=2024-01-01&x="
    assert one(r.render_template(v(row), "plain")) == "plain"
    assert one(r.render_template(v(row), "{{now}}", F.lit("2024-05-06 07:08:09").cast("timestamp"))) == "2024-05-06 07:08:09"


def test_regex_operator(one):
    assert one(r.regex_suffix(F.lit("aBc"), "b!##[$0]")) == "a[B]c"
    assert one(r.regex_suffix(F.lit("x1y"), r"(\d)##<$1>$9")) == "x<1>y"
    assert one(r.regex_suffix(F.lit("keep"), "(##x")) == "keep"


def test_patterns_are_judged_by_the_engine_that_runs_them(one):
    assert one(r.regex_suffix(F.lit("keep a{"), "a{##x")) == "keep a{"
    assert one(r.regex_suffix(F.lit("in 2024"), r"(?P<the_year>\d+)##[${the_year}]")) == "in [2024]"
    assert one(r.regex_suffix(F.lit("a1b22"), r"\p{L}(?<n>\d)##$n-$none|")) == "1-|2-|2"
    assert one(r.regex_suffix(F.lit("5 a"), r"(\d)##$1 $")) == "5 $ a"
    assert one(r.regex_suffix(F.lit("ab"), r"(?>a)##$$")) == "$b"


def test_field_defaults(one):
    assert one(r.json_field(v({"vod_name": "n", "title": "t"}), "", "ruleTitle")) == "n"
    assert one(r.json_field(v({"aid": 5}), "https://x/?aid={{$.aid}}", "ruleLink")) == "https://x/?aid=5"
    assert one(r.json_field(v({"note": "a-b-c"}), "$.note##-", "ruleTitle")) == "abc"


def test_rule_classes(one):
    got = one(*[r.classify_rule(F.lit(x)) for x in ["", "@js:1", "a{{x}}", "$.a##b", "$.a", "//a", "class.x@text"]])
    assert got == ("empty", "script", "template", "regex", "json", "xpath", "plain")


def test_headers(one):
    assert one(r.parse_headers(F.lit('{"A":"x","B":2,"C":true,"D":{},"E":null}'))) == {"A": "x", "B": "2", "C": "true"}
    assert one(r.parse_headers(F.lit("A: x:y\n:z\njunk\nB :"))) == {"A": "x:y", "B": ""}
    assert one(r.parse_headers(F.lit("{broken"))) == {}


STORE = {
    "bins": [{"n": 1, "t": "a"}, {"n": 2, "t": "b", "x": {"n": 9}}, {"n": "3"}, {"m": None, "on": True}],
    "t": "top", "box": {"t": "boxed"}, "it's?": {"q": 1}, "rows": [{"box": {"t": "x"}}, {"box": {"t": "y"}}]}
FOUND = {
    "$..t": ["top", "a", "b", "boxed", "x", "y"], "$.bins[0:2].n": ["1", "2"], "$.bins[-1].on": ["true"], "$.bins[?(@.n>1)].t": ["b"],
    "$.bins[?(@.n > 1 && @.t == 'b')].n": ["2"], "$.bins[?(@.n==1 || @.x)].n": ["1", "2"], "$.bins[::2].n": ["1", "3"],
    "$.bins[::-1].n": ["3", "2", "1"], "$.bins[0,2].n": ["1", "3"], "$['t','box'].t": ["boxed"], "bins.n": ["1", "2", "3"],
    "$..n": ["1", "2", "9", "3"], "$.*.t": ["a", "b", "boxed"], '$["it\'s?"].q': ["1"], "$.bins[?(@.x.n == 9)].t": ["b"], "@.t": ["top"],
    "$.bins[1:]..n": ["2", "9", "3"], "$.bins[?(@.t != 'a')].t": ["b"], "$.rows[-2:].box.t": ["x", "y"], "$.bins[:-1].n": ["1", "2", "3"],
    "$.bins[3:0:-2].n": ["2"], "$.bins[?(@.m == null)].on": ["true"], "$.bins[?(@.on == true)].on": ["true"], "$.bins[?(@.n < 'z')].n": ["3"],
    "$.bins[9].n": [], "$.bins[5:9].n": [], "$.bins[::0].n": []}
NO_PATHS = ["$.bins[?(", "$.bins[a]", "$$.t", "$.bins[", "$.bins[?(@.n ~ 1)]", "$.bins[-]", "$.a]b"]


def test_every_form_as_one_path_and_as_rows(one, spark):
    paths = [*FOUND, *NO_PATHS]
    for low in range(0, len(paths), 9):
        some = paths[low: low + 9]
        assert one(F.array(*[j.json_path(v(STORE), p) for p in some])) == [FOUND.get(p, []) for p in some]
    assert all(j.path_steps(p) is None for p in NO_PATHS) and all(j.path_steps(p) is not None for p in FOUND)
    df = spark.createDataFrame([(p, json.dumps(STORE)) for p in paths], "path string, body string").withColumn("steps", j.path_plan(F.col("path")))
    rows = df.select("path", F.col("steps").isNotNull().alias("ok"), F.transform(j.json_select(F.parse_json("body"), F.col("steps")), j.json_text).alias("t")).collect()
    assert {x.path: x.t for x in rows} == FOUND | dict.fromkeys(NO_PATHS, [])
    assert {x.path for x in rows if not x.ok} == set(NO_PATHS)


def test_one_deep_document_leaves_the_plan_of_others_alone(spark):
    deep = {"k": 0}
    for i in range(400):
        deep = {"a": deep, "k": i + 1} if i % 2 else [deep]
    rows = [(1, json.dumps(deep)), (2, '{"k":7}'), (3, None), (4, "{"), (5, "")]
    df = spark.createDataFrame(rows, "id int, body string")
    found = j.json_descend(df, "k")
    assert {(x["id"], x["n"]) for x in found.groupBy("id").agg(F.count("*").alias("n")).collect()} == {(1, 201), (2, 1)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


RULES = {
    "$.t": "top", "$.none||$.box.t": "boxed", "/v/{{$.bins[0].n}}?q={{ $.t##o(.)##<$1> }}&z={{none}}": "/v/1?q=t<p>&z=", "$.t##P!##<$0>$$$7": "to<p>$",
    "$.t##(open##x": "top", "$.t##(?<w>o)##[${w}${u}]": "t[o]p", "'a||b'||$.box.t": "boxed", "$..t": "top", "$.bins[?(": "", "": "", "{{$.bins[}}x": "x"}


def test_rules_as_rows_agree_with_single_rules(one, spark):
    df = spark.createDataFrame([(x, json.dumps(STORE)) for x in RULES], "rule string, body string").withColumn("plan", r.rule_plan(F.col("rule")))
    got = df.select("rule", F.get(r.json_fields_by(F.parse_json("body"), F.array("plan"), ["ruleImage"]), F.lit(0)).alias("t")).collect()
    assert {x.rule: x.t for x in got} == RULES
    assert one(F.array(*[r.json_field(v(STORE), rule, "ruleImage") for rule in RULES])) == list(RULES.values())


def test_usual_keys_stand_in_for_rules_that_find_nothing(spark):
    df = spark.createDataFrame([("$.x", '{"name":"n","url":"/u","pic":"/p"}')], "rule string, body string")
    plan = F.transform(F.array(F.col("rule"), F.lit(""), F.lit("$["), F.lit("$.y||$.z")), r.rule_plan)
    row = df.select(r.json_fields_by(F.parse_json("body"), plan, ["ruleTitle", "ruleLink", "ruleImage", "rulePubDate"]).alias("f")).first()
    assert row.f == ["n", "/u", "/p", ""]
