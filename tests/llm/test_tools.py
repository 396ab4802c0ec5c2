import datetime
import json
import random

import pytest

from quernstone.llm import tools

CALLS = "conv long, call_id string, turn long, name string, arguments string, after array<string>"
RESULTS = "conv long, call_id string, turn long, content string"


PLAIN = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"turn": {"type": "integer", "minimum": 0}, "text": {"type": "string", "minLength": 1}}}}


def run(spark, calls, results, schemas=PLAIN, local=tools.LOCAL):
    return tools.format_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas, local).collect()


def test_links_orders_validates(spark):
    ok = '{"turn": 1.0, "text": "b\\n\\"é"}'
    got = {(r.conv, r.call_id): r for r in run(spark, [
        (1, "a", 1, "reply", ok, ["z"]), (1, "b", 2, "reply", ok, None), (1, "z", 9, "reply", ok, ["b", "nowhere"]),
        (1, "b", 5, "reply", "{}", None), (2, "a", 1, "other", "{}", []), (2, "q", 2, "reply", "{oops", []), (2, "l", 2, "reply", "[1]", []),
        (None, "a", 1, "reply", '{"text":"","turn":-1,"x":NaN}', ["a"]), (3, None, 1, "reply", None, []),
    ], [(1, "a", 3, "one"), (1, "a", 2, "first"), (2, "lost", 4, "x"), (None, "a", 2, None), (1, None, 1, "gone")])}
    assert [(got[1, k].position, got[1, k].status, got[1, k].n_calls, got[1, k].n_results) for k in "bza"] == [(1, "pending", 2, 0), (2, "pending", 1, 0), (3, "linked", 1, 2)]
    assert got[1, "a"].json == '{"arguments":{"text":"b\\n\\"é","turn":1},"conversation":1,"id":"a","name":"reply","position":3,"result":"first","status":"linked"}'
    assert got[1, "a"].valid and got[2, "a"].errors == ["no schema"] and got[2, "q"].errors == ["not JSON"] and got[2, "l"].errors == ["$: not object"]
    assert got[2, "lost"].status == "orphan" and got[2, "lost"].valid is None
    assert got[None, "a"].cyclic and got[None, "a"].errors == ["not JSON"] and got[3, None].status == "pending" and len(got) == 9


@pytest.mark.parametrize("local", [0, 1000])
def test_cycles_and_long_chains(spark, local):
    n = 9
    calls = [(1, str(k), n - k, "reply", "{}", [str(k - 1)]) for k in range(n)]
    calls += [(2, "a", 1, "reply", "{}", ["b"]), (2, "b", 2, "reply", "{}", ["a"]), (2, "c", 3, "reply", "{}", ["b"]), (2, "d", 4, "reply", "{}", [])]
    got = run(spark, calls, [], local=local)
    assert [r.call_id for r in sorted(got, key=lambda r: r.position) if r.conv == 1] == [str(k) for k in range(n)]
    assert {r.call_id: r.cyclic for r in got if r.conv == 2}["d"] is False and all(r.cyclic for r in got if r.conv == 2 and r.call_id in "ab")


def plain_order(calls):
    """{(conv, id): (position, cyclic)} one call after the other; ids and turns are unique in a conversation."""
    out = {}
    for conv in {c[0] for c in calls}:
        own = sorted((c for c in calls if c[0] == conv), key=lambda c: (c[2], c[1]))
        rank = {c[1]: k for k, c in enumerate(own)}
        after = {c[1]: [d for d in c[5] if d in rank] for c in own}
        place, left = {}, set(rank)
        while ready := [k for k in left if all(d in place for d in after[k])]:
            for k in ready:
                place[k] = max([rank[k], *(place[d] + 1 for d in after[k])])
            left -= set(ready)
        for position, k in enumerate(sorted(rank, key=lambda k: (k in left, 0 if k in left else place[k], rank[k])), 1):
            out[conv, k] = (position, k in left)
    return out


@pytest.mark.parametrize("local", [0, 1000])
def test_order_against_plain(spark, local):
    rng = random.Random(5)
    calls = [(conv, f"c{k}", turn, "reply", "{}", [f"c{rng.randrange(9)}" for _ in range(rng.choice([0, 0, 1, 1, 2]))]) for conv in range(12) for k, turn in enumerate(rng.sample(range(40), 8))]
    got = {(r.conv, r.call_id): (r.position, r.cyclic) for r in run(spark, calls, [], local=local)}
    assert got == plain_order(calls) and len({c for _, c in got.values()}) == 2


@pytest.mark.parametrize("local", [0, 1000])
def test_a_cycle_beside_a_late_turn(spark, local):
    calls = [(1, "a", 1, "reply", "{}", ["b"]), (1, "b", 2, "reply", "{}", ["a"]), (1, "late", 10**9, "reply", "{}", []), (1, "behind", 3, "reply", "{}", ["late"])]
    got = {r.call_id: (r.position, r.cyclic) for r in run(spark, calls, [], local=local)}
    assert got == {"late": (1, False), "behind": (2, False), "a": (3, True), "b": (4, True)}


def test_nothing_fails_on_bad_arguments_and_schemas(spark):
    deep, big = "[" * 100_000 + "]" * 100_000, '{"n": ' + "9" * 400 + "}"
    schemas = {"any": {"type": "any"}, "pattern": {"properties": {"a": {"pattern": "("}}}, "keyword": {"unevaluatedItems": False}, "true": True, "false": False, "int": {"properties": {"n": {"type": "integer", "multipleOf": 3}}}}
    rows = [("d", "int", deep), ("b", "int", big), ("a", "any", "{}"), ("p", "pattern", "{}"), ("k", "keyword", "{}"), ("t", "true", "{}"), ("f", "false", "{}"), ("s", "true", '{"x": "\\ud800"}'), ("l", "int", '{"n": ' + "9" * 5000 + "}"), ("e", "true", "")]
    calls = spark.createDataFrame([(datetime.date(2024, 1, 2), i, 1, n, a, []) for i, n, a in rows], CALLS.replace("conv long", "conv date"))
    got = {r.call_id: r for r in tools.format_calls(calls, spark.createDataFrame([], RESULTS.replace("conv long", "conv date")), schemas).collect()}
    assert {k: r.errors for k, r in got.items()} == {"d": ["too deep"], "b": [], "a": ['schema: unknown type "any"'], "p": ["schema: pattern is no regular expression"], "k": ["schema: unknown keyword unevaluatedItems"], "t": [], "f": ["$: not allowed"], "s": [], "l": ["not JSON"], "e": ["not JSON"]}
    assert json.loads(got["b"].json)["arguments"]["n"] == int("9" * 400) and '"conversation":"2024-01-02"' in got["t"].json and "\\ud800" in got["s"].json
    messages = [(1, 0, f"<tool_call>{deep}</tool_call>"), (1, 1, '<tool_call>{"id": "\\ud800", "arguments": NaN}</tool_call>'), (1, 2, '<tool_call>{"id": "\\ud800x", "arguments": "\\ud800"}</tool_call>')]
    parsed = tools.parse_messages(spark.createDataFrame(messages, "conv_id long, turn int, text string")).collect()
    assert [(r.id, r.arguments) for r in parsed] == [(None, deep), (None, messages[1][2][11:-12]), ("\ufffdx", "\ufffd")]


def test_combined_schemas():
    schema = {"anyOf": [{"type": "string"}, {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1, "multipleOf": 0.1}], "not": {"const": "no"}}
    assert [tools.violations(x, schema) for x in ("a", 0.3, "no", 0, 1, 0.25, None)] == [[], [], ["$: what it must not be"], *[["$: none of anyOf"]] * 4]
    assert tools.violations([1, True, 1.0], {"uniqueItems": True, "items": {"oneOf": [{"enum": [1]}, {"type": "boolean"}]}}) == ["$: repeated items"]
    assert tools.violations(True, {"enum": [1]}) == ["$: not in enum"] and tools.violations(1.0, {"const": 1}) == []
    assert tools.violations({"a": 1, "b": "x"}, {"additionalProperties": {"type": "string"}, "minProperties": 3, "allOf": [{"required": ["c"]}]}) == ["$.c: missing", "$: too few properties", "$.a: not string"]
    assert tools.unsound({"items": {"minItems": -1}}) == "minItems is no count" and tools.unsound([]) == "no schema object" and tools.unsound({"properties": {"$ref": {"type": "null"}}}) is None


def test_turns_give_orders_cycles_and_missing_results(spark):
    rows = [(1, 0, "user", "x" * 50), (1, 1, "assistant", "r"), (1, 2, "user", "x" * 10), (2, 0, "user", "x" * 50), (2, 2, "user", "x" * 20), (2, 3, "assistant", None), (3, 5, "assistant", "lost"), (None, 0, "user", None), (4, None, "user", "t"), (4, 0, None, "t")]
    got = tools.format_calls(*tools.turns_as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), tools.REPLY).collect()
    assert sorted((r.conv or 0, r.call_id or "", r.position, r.status, r.cyclic) for r in got) == [(0, "turn-0", 1, "pending", False), (1, "turn-0", 2, "linked", False), (1, "turn-2", 1, "pending", False), (2, "turn-0", 1, "pending", True), (2, "turn-2", 2, "linked", True), (3, "turn-4", 1, "orphan", False), (4, "", 1, "pending", False)]


def test_random_orders_are_topological(spark):
    rng = random.Random(8)
    calls = []
    for conv in range(6):
        order = rng.sample(range(12), 12)
        for place, k in enumerate(order):
            calls.append((conv, f"c{k}", rng.randrange(12), "reply", "{}", [f"c{j}" for j in rng.sample(order[:place], min(place, rng.randint(0, 2)))]))
    at = {(r.conv, r.call_id): r.position for r in run(spark, calls, [])}
    assert sorted(at.values()) == sorted([k for k in range(1, 13)] * 6)
    assert all(at[c[0], c[1]] > at[c[0], d] for c in calls for d in c[5])


def test_parse(spark):
    text = 'x <tool_call>{"id": 7, "name": "f", "arguments": {"b": 1, "a": [1.5, null]}, "after": ["p", 3]}</tool_call><tool_call>bad</tool_call>'
    rows = [(1, 0, text), (1, 1, '<tool_result id="7">ok</tool_result>'), (1, 2, None), (1, 3, "plain")]
    got = tools.parse_messages(spark.createDataFrame(rows, "conv_id long, turn int, text string")).collect()
    assert [(r.kind, r.id, r.name, r.after, r.content) for r in got] == [("call", "7", "f", ["p", "3"], None), ("call", None, None, [], None), ("result", "7", None, [], "ok")]
    assert json.loads(got[0].arguments) == {"a": [1.5, None], "b": 1} and got[1].arguments == "bad"


def test_schema_rules():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": ["integer", "null"], "maximum": 3}, "s": {"type": "string", "pattern": "^x", "maxLength": 2}, "l": {"type": "array", "items": {"enum": [1, 2]}, "minItems": 1}, "c": {"const": 5}}}
    assert tools.violations({"a": 3, "s": "x", "l": [1], "c": 5}, schema) == tools.violations({"a": None}, schema) == []
    assert tools.violations({"a": True, "s": "yyy", "l": [], "c": 4, "z": 0}, schema) == ["$.a: not integer or null", "$.c: not the constant", "$.l: too few items", "$.s: too long", "$.s: pattern", "$.z: unknown"]
    assert tools.violations({"l": [3]}, schema) == ["$.a: missing", "$.l[0]: not in enum"]


def test_empty(spark):
    assert run(spark, [], []) == []
