import json

from promptframe.llm.toolcalls import Field, calls_in, canonical, link, transcripts

TOOLS = {"find": {"text": Field("string", longest=5), "top": Field("integer", required=False, least=1),
                  "kind": Field("string", required=False, one_of=("a", "b"))}}
CALLS = "conv_id long, call_id string, after string, name string, arguments string, turn long, extra int"
RESULTS = "conv_id long, call_id string, content string, turn long"


def linked(spark, calls, results):
    calls = spark.createDataFrame([(*c, 0) for c in calls], CALLS)
    return link(calls, spark.createDataFrame(results, RESULTS), TOOLS).collect()


def test_links_order_and_states(spark):
    ok = '{"text": "x"}'
    calls = [(1, "a", None, "find", ok, 0), (1, "b", "a", "find", ok, 2), (1, "c", "b", "find", ok, 4),
             (1, "x", "y", "find", ok, 6), (1, "y", "x", "find", ok, 7), (1, "z", "gone", "find", ok, 8),
             (None, "a", None, "find", ok, 0), (1, None, None, "find", ok, 9), (1, "c", "b", "find", ok, 4)]
    results = [(1, "a", 'say "é"\n', 1), (1, "q", None, 3), (None, "a", "r", 1), (1, None, "n", 5), (1, "a", "later", 9)]
    every = linked(spark, calls, results)
    got = {(r.conv_id, r.call_id, r.kind): (r.position, r.status, r.copies) for r in every if r.status != "conflict"}
    assert [(r.call_id, r.kind, r.position, r.copies) for r in every if r.status == "conflict"] == [("a", "result", None, 1)]
    assert got == {
        (1, "a", "call"): (0, "ok", 1), (1, "a", "result"): (1, "ok", 1), (1, "b", "call"): (4, "no result", 1),
        (1, "c", "call"): (6, "no result", 2), (1, "x", "call"): (None, "cycle", 1), (1, "y", "call"): (None, "cycle", 1),
        (1, "z", "call"): (2, "no result", 1), (None, "a", "call"): (0, "ok", 1), (None, "a", "result"): (1, "ok", 1),
        (1, None, "call"): (None, "no id", 1), (1, "q", "result"): (None, "orphan", 1),
        (1, None, "result"): (None, "no id", 1)}


def test_messages_are_canonical_json(spark):
    args = '{ "top": 2, "text": "\\u0041\\"b", "kind": "a" }'
    rows = linked(spark, [(1, "a", None, "find", args, 0), (1, "n", None, None, "no json", 1)], [(1, "a", None, 1)])
    text = {(r.call_id, r.kind): r.message for r in rows}
    assert text["a", "call"] == (
        '{"arguments":{"kind":"a","text":"A\\"b","top":2},"id":"a","name":"find","type":"function"}')
    assert text["a", "result"] == '{"role":"tool","tool_call_id":"a"}'
    assert json.loads(text["n", "call"]) == {"arguments": "no json", "id": "n", "type": "function"}


def test_arguments_are_validated(spark):
    cases = {
        '{"text":"x"}': "", "{}": "text: missing", '{"text":null}': "text: missing", '{"text":3}': "text: not string",
        '{"text":"toolong"}': "text: too long", '{"text":"x","top":0}': "top: too small", '{"text":"x","top":1.5}': "top: not integer",
        '{"text":"x","kind":"c"}': "kind: not allowed", '{"text":"x","z":1,"b":2}': "b: unexpected; z: unexpected",
        "[1]": "not an object", "{": "not an object", None: "not an object"}
    calls = [(1, str(k), None, "find", a, k) for k, a in enumerate(cases)] + [(1, "t", None, "other", "{}", 99)]
    got = {r.call_id: "; ".join(r.errors) for r in linked(spark, calls, [])}
    assert got == {**{str(k): e for k, e in enumerate(cases.values())}, "t": "unknown tool: other"}


def test_a_long_chain_in_one_conversation(spark):
    n = 300
    calls = [(7, f"c{k}", f"c{k - 1}" if k else None, "find", '{"text":"x"}', k) for k in range(n)]
    got = {r.call_id: r.position for r in linked(spark, calls, [(7, "c0", "r", 1)]) if r.kind == "call"}
    assert got == {f"c{k}": 2 * k for k in range(n)}


def test_calls_in_texts_and_empty_tables(spark):
    call = json.dumps({"tool_calls": [{"id": "i", "function": {"name": "find", "arguments": '{"text":"q"}'}}]})
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"i","content":"r"}'),
            (1, 3, "assistant", None), (1, 4, "tool", "no json")]
    calls, results = calls_in(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted((r.kind, r.status) for r in link(calls, results, TOOLS).filter("call_id IS NOT NULL").collect())
    assert got == [("call", "ok"), ("result", "ok")]
    none = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert link(*none, TOOLS).count() == 0


def test_canonical(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":1.50,"c":"\\u00e9"}}',), ("x",)], "j string")
    assert [r[0] for r in df.select(canonical(df.j)).collect()] == ['{"a":{"c":"é","d":1.5},"b":1}', None]


def test_positions_have_no_ties_and_nothing_is_lost(spark):
    ok = '{"text": "x"}'
    calls = [(1, f"c{k}", "root" if k else None, "find", ok, 5) for k in range(1, 40)] + [(1, "root", None, "find", ok, 0)]
    calls += [(1, "c1", "root", "find", '{"text": "y"}', 5), (1, "c1", "root", "find", '{"text": "y"}', 6), (2, "only", None, "find", ok, 0)]
    results = [(1, f"c{k}", f"r{k}", 6) for k in range(1, 40)]
    rows = linked(spark, calls, results)
    placed = sorted(r.position for r in rows if r.conv_id == 1 and r.position is not None)
    assert placed == [0, *range(2, 80)] and [r.position for r in rows if r.conv_id == 2] == [0]
    order = [r.call_id for r in sorted((r for r in rows if r.conv_id == 1 and r.kind == "call" and r.position is not None),
                                       key=lambda r: r.position)]
    assert order == ["root", *sorted(f"c{k}" for k in range(1, 40))]
    assert [(r.call_id, r.copies, r.message) for r in rows if r.status == "conflict"] == [
        ("c1", 2, '{"arguments":{"text":"y"},"id":"c1","name":"find","type":"function"}')]


def test_turns_of_every_role(spark):
    call = json.dumps({"tool_calls": [{"id": "i", "function": {"name": "user", "arguments": "{}"}}]})
    rows = [(1, 0, "user", "a b c d e"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"i","content":"r"}'),
            (1, 3, "tool", "plain"), (1, 4, None, 'lost "turn"'), (1, 4, None, 'lost "turn"'), (None, 0, "system", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS message", "2 AS at")
    got = sorted((str(r.conv_id), str(r.call_id), r.kind, r.status, r.copies) for r in transcripts(df).collect())
    assert got == [
        ("1", "1:0", "call", "ok", 1), ("1", "1:0", "result", "ok", 1), ("1", "None", "message", "no role", 2),
        ("1", "None", "result", "no id", 1), ("1", "i", "call", "invalid arguments", 1), ("1", "i", "result", "ok", 1),
        ("None", "0", "call", "invalid arguments", 1)]
    assert transcripts(df.limit(0)).count() == 0
