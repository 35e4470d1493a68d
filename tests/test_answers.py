import json

import pytest
from pyspark.sql import functions as F

from promptframe.functions.answers import extract_json, has_error, is_json, read_response
from promptframe.operators import analysis


def one(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("c"))).collect()]


CASES = [
    ('{"a": 1}', {"a": 1}), ("[1, 2]", {"response": [1, 2]}), ('"hi"', {"text": "hi"}), (" 42 ", {"value": 42}),
    ("true", {"value": True}), ("null", None), ("", None), (None, None), ("garbage", None),
    ('pre ```json\n{"a": 12}\n``` post', {"a": 12}), ("'quoted'", {"text": "quoted"}), ("'", {"text": ""}),
    ('see {"key": 5} there', {"key": 5}), ('x [1, 2, 3] y', {"response": [1, 2, 3]}),
    ('{"a": 1, "b": [1, 2,],}', {"a": 1, "b": [1, 2]}), ("{'a': 'x', b: 2}", {"a": "x", "b": 2}),
    ('{"a":1} {"b":2}', None), ('{"a":1,"a":2}', {"a": 2}), ('{"a": "line\nbreak"}', None),
    ('1,"z":1} x', None), ('{"a": {"b": ["é", null]}}', {"a": {"b": ["é", None]}}),
]


def test_extract_json(spark):
    got = one(spark, [c for c, _ in CASES], extract_json)
    assert [None if g is None else json.loads(g) for g in got] == [w for _, w in CASES]


def test_whole_text_must_be_json(spark):
    good = ["{}", "1", ' "x" ', "[]", "null", '{"v":1,"v":2}']
    bad = ["", "{} {}", "{}]", "{'a':1}", "1,2", '1, "b":2', "[1,]", '"a', "nul"]
    assert one(spark, good, is_json) == [True] * len(good)
    assert one(spark, bad, is_json) == [False] * len(bad)


def test_response_shapes(spark):
    responses = [
        '{"choices":[{"message":{"content":"x"},"_extra":{"k":1}},{"message":{"content":null}}]}',
        '{"output":[{"type":"search"},{"content":[{"text":"hi"}]}]}', "{}", None, '{"choices":[]}', '{"choices":null}',
        '{"x":1,"y":2}', '{"output":[{"type":"only"}]}']
    got = [(r["count"], [tuple(i) for i in r["items"]]) for r in one(spark, responses, read_response)]
    assert got == [
        (2, [(0, "x", '{"k":1}', None), (1, None, None, None)]), (2, [(1, "hi", None, None)]),
        (0, [(0, None, None, "Null response")]), (0, [(0, None, None, "Null response")]),
        (0, [(0, None, None, "Empty response from API")]), (0, [(0, None, None, "Empty response from API")]),
        (0, [(0, None, None, "Unknown response format: dict_keys(['x', 'y'])")]), (1, [])]
    assert one(spark, responses, has_error) == [True, True, True, True, True, True, True, False]


def chat(*contents, extra=None):
    choices = [{"message": {"content": c}} for c in contents]
    if extra:
        choices[0]["_extra"] = extra
    return json.dumps({"choices": choices})


@pytest.fixture
def records(spark):
    responses = [
        chat('{"result": [{"a": 1}, {"b": 2, "a": 3}]}'), chat('{"data": []}'), chat('{"data": [1]}', '{"list": ["x"]}'),
        chat('{"data": [1]}', '{"n": 1}'), chat('{"result": "[1]"}'), chat("oops"),
        chat('["p", {"q": 1}]', extra={"src": "s"})]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(responses)], "combo_id bigint, response string")
    return df.withColumns({"timestamp": F.lit("T"), "masked": F.create_map(F.lit("v"), F.col("combo_id").cast("string"))})


def test_flatten(records):
    rows = analysis.flatten_answers(records).orderBy("combo_id", "pos", "list_pos").collect()
    got = [(r["combo_id"], r["pos"], r["list_pos"], r["data"] and json.loads(r["data"]), r["choice"]) for r in rows]
    assert got == [
        (0, 0, 0, {"a": 1}, None), (0, 0, 1, {"b": 2, "a": 3}, None), (1, 0, 0, {}, None),
        (2, 0, 0, {"value": 1}, 0), (2, 1, 0, {"value": "x"}, 1),
        (3, 0, 0, {"data": [1]}, 0), (3, 1, 0, {"n": 1}, 1),
        (4, 0, 0, {"result": "[1]"}, None), (5, 0, 0, None, None),
        (6, 0, 0, {"value": "p"}, None), (6, 0, 1, {"q": 1}, None)]
    assert rows[8]["error"] == "Error parsing JSON" and rows[8]["raw"] == "oops"


def test_columns_in_order_of_appearance(records):
    rows = analysis.flatten_answers(records)
    table = analysis.to_columns(rows, keep=["combo_id", "pos", "list_pos"])
    assert table.columns[3:] == [
        "a", "input_v", "_timestamp", "b", "value", "_choice", "data", "n", "result", "_error", "_raw", "src", "q"]
    got = {(r["combo_id"], r["pos"], r["list_pos"]): r for r in table.collect()}
    assert got[0, 0, 1]["a"] == "3" and got[0, 0, 1]["b"] == "2" and got[0, 0, 0]["b"] is None
    assert got[2, 1, 0]["_choice"] == "1" and got[6, 0, 1]["src"] == "s" and got[5, 0, 0]["_raw"] == "oops"
    assert all(r["_timestamp"] == "T" and r["input_v"] == str(k[0]) for k, r in got.items())
    named = analysis.to_columns(rows, ["a", "zz"])
    assert named.columns == ["a", "zz"] and named.filter("zz IS NOT NULL").count() == 0


def test_answers_of_many_keys_have_as_many_columns(spark):
    import json

    answer = json.dumps({f"k{n:04d}": n for n in range(2100)})
    text = json.dumps({"choices": [{"message": {"content": answer}}]})
    df = spark.createDataFrame([(0, text, "t", {})], "combo_id long, response string, timestamp string, masked map<string,string>")
    names = analysis.column_names(analysis.flatten_answers(df), timestamp=None)
    assert names == [f"k{n:04d}" for n in range(2100)]


def test_user_analysis(spark, records):
    data = records.withColumn("usage", F.lit(None).cast("struct<cost:double>"))
    analysis.register_analysis(
        "sizes", lambda response, timestamp, usage: {"n": len(response["choices"])},
        lambda rows: {"n": sum(r["n"] for r in rows)}, schema="n bigint", reduce_schema="n bigint")
    assert analysis.analyse(data, "sizes").collect()[0]["n"] == 9
    analysis.register_analysis("count", lambda df: df.select("combo_id"), lambda df: df.groupBy().count())
    assert analysis.analyse(data, "count").first()[0] == 7
    for name in ("sizes", "count"):
        del analysis.ANALYSES[name]


def test_cost_analysis(spark):
    df = spark.createDataFrame(
        [("r", '{"tokens in": 5, "cost in": 0.5}', None, 2.0, 7.0), ("r", "{}", (1, 2, 3, 4, 0.25, 0.5, 0.0, 0.75), None, None)],
        "run_name string, response string, usage struct<tokens_in:bigint,tokens_out:bigint,bytes_in:bigint,"
        "bytes_out:bigint,cost_in:double,cost_out:double,discount:double,cost:double>, elapsed_time double, cost double")
    got = analysis.analyse(df, "cost").first().asDict()
    assert got == {"Tokens Input": 6, "Tokens Output": 2, "Bytes Input": 3, "Bytes Output": 4, "Cost Input": 0.75,
                   "Cost Output": 0.5, "Cost": 1.25}
    from promptframe.operators.usage import run_info

    assert run_info(df).first().asDict() == {"elapsed_time": 2.0, "total_cost": 7.75}


def test_places_beyond_any_width(spark):
    df = spark.createDataFrame(
        [(2**62, 1, 100_000, '{"late":1,"b":1}', None, None, None, None),
         (2**62, 1, 99_999, '{"early":1}', None, None, None, None),
         (2**62, 100_001, 0, '{"last":1}', None, None, None, None),
         (2**62 - 1, 7, 999_999_998, '{"first":1,"second":1}', None, None, None, None)],
        "combo_id long, pos int, list_pos int, data string, extra string, choice int, error string, raw string")
    assert analysis.column_names(df) == ["first", "second", "early", "late", "b", "last"]
    assert analysis.column_names(df, most=2) == ["first", "second"]


def test_keys_beyond_the_columns_stay_in_a_variant(spark):
    df = spark.createDataFrame(
        [(1, '{"a":1,"b":null,"c":{"d":[1]}}', '{"e":"x"}', None, None, None),
         (2, None, None, None, "bad", "text"), (3, '{"a":2}', None, 5, None, None)],
        "combo_id long, data string, extra string, choice int, error string, raw string")
    table = analysis.to_columns(df, keep=["combo_id"], most=1)
    assert table.columns == ["combo_id", "a", "_rest"]
    got = {r[0]: (r[1], r[2]) for r in table.select("combo_id", "a", F.to_json("_rest")).collect()}
    assert got == {1: ("1", '{"c":"{\\"d\\":[1]}","e":"x"}'), 2: (None, '{"_error":"bad","_raw":"text"}'),
                   3: ("2", '{"_choice":"5"}')}
    assert "_rest" not in analysis.to_columns(df, keep=["combo_id"]).columns


def test_typed_columns(spark):
    df = spark.createDataFrame(
        [(1, '{"n":1,"x.y":"z","more":[1,{"k":null}]}'), (2, '{"n":"many","x.y":null}'), (3, "[1,2]"), (4, "7"),
         (5, "{broken"), (6, None), (7, "{}"), (8, '{"n":null}')], "id int, data string")
    typed = analysis.typed_columns(df, {"n": "int", "x.y": "string"}, ["id"])
    got = {r[0]: tuple(r)[1:] for r in typed.select("id", "n", "`x.y`", F.to_json("rest")).collect()}
    assert got == {1: (1, "z", '{"more":[1,{"k":null}]}'), 2: (None, None, '{"n":"many"}'), 3: (None, None, "[1,2]"),
                   4: (None, None, "7"), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None),
                   8: (None, None, None)}
    found = {r[0]: r[1] for r in analysis.answer_schema(df.filter("id <> 3 AND id <> 4"), "id").collect()}
    assert found[1] == "OBJECT<more: ARRAY<VARIANT>, n: BIGINT, `x.y`: STRING>" and found[5] is None and found[6] is None
    assert analysis.typed_columns(df, {}, ["id"]).filter("id = 1").select(F.to_json("rest")).first()[0] == \
        '{"more":[1,{"k":null}],"n":1,"x.y":"z"}'


def test_keyed_reduce_holds_one_key(spark):
    """More keys and more rows of one key than a call is given; null and NaN keys are groups."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, F.col("id") / 1).alias("k"),
        F.lit(1).cast("long").alias("n"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    most = analysis.REDUCE_ROWS

    def reduce(group):
        assert len(group) <= most and len({str(r["k"]) for r in group}) == 1
        return [{"k": group[0]["k"], "n": sum(r["n"] for r in group), "m": {"a": 2}}]

    out = analysis.python_reduce(rows, reduce, "k double, n bigint, m map<string,int>", ["k"])
    assert out.count() == 20_002
    big = {str(r["k"]): r["n"] for r in out.filter("n > 1").collect()}
    assert big == {"nan": 20_000, "None": 20_000}
    assert out.filter("m['a'] = 2").count() == 20_002
    assert analysis.python_reduce(rows.limit(0), reduce, "k double, n bigint, m map<string,int>", ["k"]).count() == 0


def test_answers_are_taken_apart_once(spark):
    """Finding the columns and filling them read the same written rows."""
    records = spark.createDataFrame(
        [(1, '{"choices":[{"message":{"content":"[{\\"a\\":1},{\\"b\\":2}]"}}]}')], "combo_id bigint, response string")
    table = analysis.to_columns(analysis.flatten_answers(records), keep=["combo_id", "list_pos"])
    assert "Generate" not in table._jdf.queryExecution().optimizedPlan().toString()
    assert [r.asDict() for r in table.orderBy("list_pos").collect()] == [
        {"combo_id": 1, "list_pos": 0, "a": "1", "b": None}, {"combo_id": 1, "list_pos": 1, "a": None, "b": "2"}]
