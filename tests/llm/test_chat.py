"""Orders, canonical arguments and single results of tool calls."""

import itertools
import json
import random

from twinloom.llm import chat

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depth string, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, kind string"
MESSAGES = "conv_id long, turn long, role string, text string, position string"
DEPENDS = "conv_id long, call_id string, on_id string, since string"


def linked(spark, calls=(), results=(), messages=(), depends=None, schema=None):
    frames = [spark.createDataFrame([(*x, "x") for x in rows], kind) for rows, kind in ((messages, MESSAGES), (results, RESULTS), (depends or [], DEPENDS))]
    calls = spark.createDataFrame([(*x, "x", "x") for x in calls], CALLS)
    return [r.asDict() for r in chat.link(frames[0], calls, frames[1], schema or {}, None if depends is None else frames[2]).collect()]


def test_a_call_comes_after_later_turns_that_it_depends_on(spark):
    r = random.Random(4)
    calls, depends = [], []
    for conv in range(6):
        names = [f"k{i}" for i in range(30)]
        calls += [(conv, r.randint(0, 2500), n, "f", "{}") for n in names]
        order = r.sample(names, 30)
        depends += [(conv, order[j], order[i]) for i, j in itertools.combinations(range(30), 2) if r.random() < 0.08]
    results = [(c, t + 1, n, "done") for c, t, n, _, _ in calls if r.random() < 0.7]
    out = linked(spark, calls, results, [(0, 7, "system", "hello")], depends)
    at = {(x["conv_id"], x["kind"], x["call_id"]): x["position"] for x in out}
    assert all(at[c, "call", on] < at[c, "call", n] for c, n, on in depends)
    assert all(at[c, "call", n] < at[c, "result", n] for c, _, n, _ in results)
    for c in range(6):
        assert sorted(x["position"] for x in out if x["conv_id"] == c) == list(range(sum(x["conv_id"] == c for x in out)))
    early, late = linked(spark, [(1, 1, "a", "f", "{}"), (1, 3, "b", "f", "{}")], depends=[(1, "a", "b")]), [(1, 1, "a", "f", "{}"), (1, 3, "b", "f", "{}")]
    assert {x["call_id"]: (x["position"], x["depth"]) for x in early} == {"b": (0, 0), "a": (1, 1)}
    assert {x["call_id"]: x["position"] for x in linked(spark, late)} == {"a": 0, "b": 1}


def test_depths_against_a_walk(spark):
    r = random.Random(9)
    names = [f"n{i}" for i in range(60)]
    edges = {(r.choice(names), r.choice(names)) for _ in range(70)}
    calls = spark.createDataFrame([(1, i, n, "f", "{}", "x", "x") for i, n in enumerate(names)], CALLS)
    depends = spark.createDataFrame([(1, a, b, "x") for a, b in edges] + [(None, "n1", "n2", "x"), (1, "n1", None, "x")], DEPENDS)

    def walk(n, path):
        if n in path:
            return -1
        below = [walk(b, {*path, n}) for a, b in edges if a == n]
        return -1 if -1 in below else max(below, default=-1) + 1 if below else 0

    got = {x["call_id"]: x["depth"] for x in chat.depths(calls, depends).collect()}
    assert got == {n: walk(n, set()) for n in names}


def test_canonical_arguments(spark):
    raw = ['{ "z":1, "b":{"y":[1, 2.5,{"k":true,"a":null}],"x":"\\u00e9\\n\\"q\\"" } }', "not json", None, "", "[3, 1]", '"s"', '{"a":1,"a":2}', '{"big":' + '"' + "w" * 200_000 + '"}']
    out = {x["call_id"]: x for x in linked(spark, [(1, i, f"c{i}", "f", a) for i, a in enumerate(raw)])}
    lines = [json.loads(out[f"c{i}"]["json"]) for i in range(len(raw))]  # every line is JSON
    assert '"arguments":{"b":{"x":"é\\n\\"q\\"","y":[1,2.5,{"a":null,"k":true}]},"z":1}' in out["c0"]["json"]
    assert [x["arguments"] for x in lines[1:7]] == ["not json", None, "", [3, 1], "s", '{"a":1,"a":2}'] and len(lines[7]["arguments"]["big"]) == 200_000
    assert all(list(x) == sorted(x) for x in lines)


def test_one_result_a_call(spark):
    results = [(1, 2, "a", "y"), (1, 2, "a", "x"), (1, 2, "a", "x"), (1, 1, "b", None), (1, 1, "b", "z"), (1, 4, None, "r"), (None, 4, "a", "r")]
    out = linked(spark, [(1, 0, "a", "f", "{}"), (1, 0, "a", "f", "{}"), (1, 0, "b", "f", "{}"), (None, 0, "a", "f", "{}")], results)
    got = sorted((x["call_id"] or "", json.loads(x["json"])["content"] or "", x["status"]) for x in out if x["kind"] == "result" and x["conv_id"] == 1)
    assert got == [("", "r", "no call"), ("a", "x", "linked"), ("a", "x", "repeated"), ("a", "y", "repeated"), ("b", "", "linked"), ("b", "z", "repeated")]
    assert {x["status"] for x in out if x["conv_id"] is None} == {"no result", "no call"} and len(out) == 11
    assert linked(spark) == [] and linked(spark, depends=[]) == []


def test_turns_with_dependencies(spark):
    turns = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(64)], "conv_id long, turn long, role string, text string")
    out = chat.link(*chat.turns_as_calls(turns), chat.REPLY, chat.turns_as_dependencies(turns)).collect()
    assert all(x["depth"] == (x["turn"] // 2 + 1).bit_length() - 1 and x["position"] == x["turn"] for x in out) and len(out) == 64
