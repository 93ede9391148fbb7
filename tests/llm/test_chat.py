import json

from phasorlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, json int"
TOOLS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "number"}, "b": {"type": "number", "maximum": 9}}, "additionalProperties": False}}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def rows():
    return [
        (1, 0, "user", 'Add "é" \n\t\x01 / \\ please', 1),
        (1, 1, "assistant", call(("c2", "add", {"b": 2, "a": {"$result": "c1"}}), ("c1", "add", '{"b": 1, "a": 1.5}'), content="wait"), 1),
        (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": {"z": 1, "a": "ü"}}), 1),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3"}), None),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": None}), None),
        (2, 0, "assistant", call(("c1", "add", {"a": "x", "b": 10, "q": 1}), ("c1", "sub", []), (None, "add", {"a": 1})), None),
        (2, 1, "assistant", call(("x", "add", {"a": {"$result": "y"}, "b": 1}), ("y", "add", {"a": {"$result": "x"}, "b": 1})), None),
        (2, 2, "tool", "{broken", None),
        (None, None, None, None, None),
        (3, 0, "user", "", None),
        (3, 0, "user", "", None),
    ]


def test_items(spark):
    got = chat.chat_items(spark.createDataFrame(rows(), SCHEMA).repartition(3), TOOLS).orderBy("conv_id", "block", "step", "place", "turn").collect()
    one = [(r.block, r.step, r.place, r.turn, r.kind, r.status) for r in got if r.conv_id == 1]
    assert one == [(0, 0, 0, 0, "message", "plain"), (1, 0, 0, 1, "message", "plain"), (1, 1, 0, 1, "call", "linked"), (1, 1, 1, 1, "call", "linked"), (1, 2, 0, 3, "result", "linked"), (1, 2, 1, 2, "result", "linked"), (4, 3, 0, 4, "result", "orphan")]
    for r in got:
        assert r.json == chat.canonical(json.loads(r.json))
    text = [r.json for r in got if r.conv_id == 1]
    assert json.loads(text[0]) == {"content": rows()[0][3], "role": "user"}
    assert text[2] == '{"arguments":{"a":1.5,"b":1},"id":"c1","name":"add"}'
    assert json.loads(text[5]) == {"content": '{"a":"ü","z":1}', "role": "tool", "tool_call_id": "c2"}
    two = [(r.status, r.errors) for r in got if r.conv_id == 2 and r.kind == "call"]
    assert [s for s, _ in two] == ["duplicate", "duplicate", "unnamed", "unanswered", "unanswered"]
    assert two[0][1] == ["$.a: not number", "$.b: over maximum", "$.q: unknown"] and two[1][1] == ["$: not object", "unknown tool"] and two[2][1] == ["$.b: missing"]
    assert two[3][1] == two[4][1] == ["needs itself"]
    assert sum(r.conv_id == 3 for r in got) == 2
    assert [r.json for r in got if r.conv_id is None] == ['{"content":null,"role":null}']


def test_order():
    assert chat.ordered([("a", {"c"}), ("b", set()), ("c", {"b"}), (None, {"nowhere"})]) == ([1, 2, 0, 3], set())
    assert chat.ordered([("a", {"a"}), ("b", {"a"}), ("c", set())]) == ([2, 0, 1], {0, 1})


def test_empty_table(spark):
    assert chat.chat_items(spark.createDataFrame([], SCHEMA)).collect() == []


def test_strict_json():
    for text in ['{"tool_calls": [], "content": NaN}', '{"tool_calls": [], "content": 1e999}', '{"tool_calls": ' + "[" * 5000 + "]" * 5000 + "}", '{"tool_calls": [' + '{"x":' * 300 + "1" + "}" * 300 + "]}"]:
        assert chat.read_message("assistant", text, {}) == (text, [], None)
    content, calls, _ = chat.read_message("assistant", r'{"tool_calls":[{"id":"\ud800","name":"\udfff","arguments":{"\ud801":"\ud83d\ude00"}}],"content":"a\udc00"}', {})
    assert content == "a\ufffd" and calls[0]["id"] == calls[0]["name"] == "\ufffd" and calls[0]["arguments"] == '{"\ufffd":"\U0001f600"}'


def test_recursive_schema_and_references():
    tree = {"type": "object", "required": ["v"], "properties": {"v": {"$ref": "#/$defs/n"}, "next": {"$ref": "#"}, "never": False, "any": True}, "$defs": {"n": {"type": "integer"}}}
    deep: dict = {"v": "x"}
    for i in range(150):
        deep = {"v": i, "next": deep}
    assert chat.validate(deep, tree) == ["$" + ".next" * 150 + ".v: not integer"]
    assert chat.validate({"v": 1, "never": 2, "any": 3, "next": {}}, tree) == ["$.never: not allowed", "$.next.v: missing"]
    loop: dict = {"type": "array"}
    loop["items"] = loop
    value: list = []
    for _ in range(3000):
        value = [value]
    assert chat.validate(value, loop) == []
    circle = {"properties": {"a": {"$ref": "#/$defs/b"}}, "$defs": {"b": {"$ref": "#/$defs/b"}}}
    assert chat.validate({"a": 1}, circle) == []


def test_long_chains_are_ordered_fast():
    calls = [(f"c{i}", {f"c{i + 1}"}) for i in range(20000)]
    order, circle = chat.ordered(calls)
    assert order == list(range(19999, -1, -1)) and not circle


def test_any_text_is_read():
    import random

    r = random.Random(3)
    parts = ['{', '}', '[', ']', '"tool_calls"', '"id"', '"arguments"', '"tool_call_id"', '"content"', ":", ",", "1", "-0", "1e400", "NaN", "null", "true", '"\\ud800"', '"$result"', '"x"', " ", "\ufeff", "\x00"]
    for _ in range(5000):
        text = "{" + "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        for role in ("assistant", "tool", None):
            content, calls, result = chat.read_message(role, text, TOOLS)
            json.dumps([content, calls, result]).encode()
            assert content is None or content.encode() is not None


def brute(messages, tools):
    """Links by looking through every message for every call."""
    out = []
    for conv, turn, role, text in messages:
        content, calls, result = chat.read_message(role, text, tools)
        def all_calls():
            for c2, t2, r2, x2 in messages:
                if conv is not None and c2 == conv:
                    for c in chat.read_message(r2, x2, tools)[1]:
                        yield t2, c
        if result is None:
            out.append((conv, turn, 0, 0, turn, "plain", (), chat.canonical({"content": content, "role": role})))
        else:
            first = min(((t, c["place"]) for t, c in all_calls() if c["id"] == result), default=None)
            block, step, place = (first[0], 2, first[1]) if first else (turn, 3, 0)
            out.append((conv, block, step, place, turn, "linked" if first else "orphan", (), chat.canonical({"content": content, "role": "tool", "tool_call_id": result})))
        for c in calls:
            same = [t for t, x in all_calls() if x["id"] == c["id"]]
            answers = [1 for c2, _, r2, x2 in messages if conv is not None and c2 == conv and chat.read_message(r2, x2, tools)[2] == c["id"]]
            status = "unnamed" if c["id"] is None else "duplicate" if len(same) > 1 else "linked" if answers else "unanswered"
            faults = []
            for need in c["needs"]:
                turns = [t for t, x in all_calls() if x["id"] == need]
                faults += [f"needs {need}: unknown"] if not turns else [f"needs {need}: of a later turn"] if min(turns) >= turn else []
            out.append((conv, turn, 1, c["place"], turn, status, (*c["errors"], *sorted(faults)), f'{{"arguments":{c["arguments"]},"id":{json.dumps(c["id"])},"name":{json.dumps(c["name"])}}}'))
    return sorted(out, key=str)


def test_against_a_brute_force_linker(spark):
    import random

    r = random.Random(11)
    messages = []
    for conv in [*range(25), None]:
        for turn in range(r.randint(1, 9)):
            x = r.random()
            ids = [f"c{r.randint(0, 6)}" if r.random() < 0.9 else None for _ in range(r.randint(0, 4))]
            if x < 0.4:
                calls = [(i, r.choice(["add", "sub"]), {"a": r.choice([1, "x", {"$result": f"c{r.randint(0, 7)}"}]), "b": r.randint(5, 12)}) for i in ids]
                messages.append((conv, turn, "assistant", call(*calls)))
            elif x < 0.7:
                messages.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{r.randint(0, 7)}", "content": r.choice(["ok", None, {"b": 1, "a": 2}])})))
            else:
                messages.append((conv, turn, r.choice(["user", "assistant", None]), r.choice(["hi", "", None, "{}", "{oops"])))
    got = chat.chat_items(spark.createDataFrame([(*m, 0) for m in messages], SCHEMA).repartition(5), TOOLS).collect()
    assert sorted(((g.conv_id, g.block, g.step, g.place, g.turn, g.status, tuple(g.errors), g.json) for g in got), key=str) == brute(messages, TOOLS)


def test_very_long_text(spark):
    big = "x" * 3_000_000
    got = chat.chat_items(spark.createDataFrame([(1, 0, "user", big, 1), (1, 1, "assistant", call(("i", "add", {"a": 1, "b": 2}), content=big), 1)], SCHEMA), TOOLS).collect()
    assert sorted(len(g.json) > 3_000_000 for g in got) == [False, True, True]


def test_the_query_validates_calls(spark, tmp_path):
    from phasorlake.llm.queries import queries

    data = [(1, 0, "assistant", call(("a", "search", {"query": "x", "top": 0}), ("b", "read", {"path": "p", "lines": [1, -1]}), ("c", "other", {})), 0), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "y"}), 0)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.kind, r.place): (r.status, r.n_errors) for r in queries()["op7_chat_formatting"](spark, str(tmp_path)).collect()}
    assert got == {("message", 0): ("plain", 0), ("call", 0): ("linked", 1), ("call", 1): ("unanswered", 1), ("call", 2): ("unanswered", 1), ("result", 0): ("linked", 0)}
