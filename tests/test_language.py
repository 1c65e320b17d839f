"""The parser and the plans of patterns, measures and checks."""

import pytest
from fixtures import NOW, machine, make
from twinloom.plans import ExecutionError, ParseError, bind, check_rows, measure, parse, parse_check, parse_temporal
from twinloom.plans.compile import limited
from twinloom.plans.language import Compare, Window


def names(twin, text, var):
    bound = bind(twin, parse(text))
    i = [n.var for n in bound.match.nodes].index(var)
    return [r[0] for r in limited(bound.df, bound).orderBy(*bound.order()).select(f"n{i}.name").collect()]


def test_shape_of_a_statement():
    q = parse("match (m:Motor) -[:ELECTRICAL]-> (:Drive) where m.spec.current.max >= 5 and m.name != 'x' or m.type == \"Motor\" at 1500 return m limit 3")
    assert [n.var for n in q.nodes] == ["m", None] and q.topologies == ("electrical",) and q.at == 1500 and q.limit == 3
    assert q.where == ((Compare("m", "spec.current.max", ">=", 5.0), Compare("m", "name", "!=", "x")), (Compare("m", "type", "=", "Motor"),))
    assert parse("MATCH (Motor) RETURN m").nodes[0].type == "Motor"


@pytest.mark.parametrize(("text", "error"), [
    ("MATCH (m:Motor) RETURN m LIMIT", "unexpected token: expected number"),
    ("MATCH (m:Motor AT 1760000000) RETURN m", "unexpected token: expected RParen"),
    ('MATCH (m:Motor) WHERE m = "x" RETURN m', "unknown property: m"),
    ("MATCH (m:Motor) WHERE m.name = 'x RETURN m", "unexpected end of query"),
    ("MATCH (m:Motor) WHERE m.x > -5 RETURN m", "unexpected token: expected number"),
    ("MATCH (m:Motor)", "unexpected token: expected RETURN"),
    ("MATCH (m:Motor) AT 5 WHERE m.name = 'x' RETURN m", "unexpected token: expected RETURN"),
    ("MATCH (m:Motor) <-[:x]- (n:N) RETURN m", "unexpected token: expected RETURN"),
])
def test_errors(text, error):
    with pytest.raises(ParseError, match=error.replace("(", r"\(")):
        parse(text)


@pytest.mark.parametrize(("window", "error"), [("bogus", "DURING expects last(n) or a..b"), ("last(12x)", "bad last() duration"), ("last()", "bad last() duration")])
def test_window_errors(window, error):
    with pytest.raises(ParseError) as e:
        parse_temporal(f"MATCH (m:Motor) MEASURE m.current DURING {window} RETURN max(m.current)", NOW)
    assert str(e.value) == error


def test_windows():
    measured = lambda w: parse_temporal(f"MATCH (m:Motor) MEASURE m.current DURING {w} RETURN max(current)", NOW).measure.window
    assert measured("last(24h)") == Window(NOW - 86400, NOW) and measured("last(90m)") == Window(NOW - 5400, NOW)
    assert measured("10..20") == Window(10, 20) and measured("-5..7") == Window(-5, 7)


def test_key_words_inside_names_and_strings(spark):
    twin = machine(spark, points={"Motor42.force": [(NOW - 5, 4.0)]})
    q = parse_check("CHECK m.force FOR (m:Motor) WHERE m.name != 'MEASURE FOR' DURING last(1h) RETURN status, points", NOW)
    assert [(r["f_status"], r["f_points"]) for r in check_rows(twin, q).collect()] == [("NO_SPEC", "1")]
    with pytest.raises(ParseError, match="unknown CHECK field: bogus"):
        parse_check("CHECK m.current FOR (m:Motor) DURING last(1h) RETURN bogus", NOW)


def test_hops_and_conditions(spark):
    twin = machine(spark)
    assert names(twin, "MATCH (d:Drive)-[:electrical]->(m:Motor)-[:MECHANICAL]->(p:Pump) RETURN p", "p") == ["Pump17"]
    assert names(twin, "MATCH (m:motor) RETURN m", "m") == [] and names(twin, "MATCH (x:Robot) RETURN x", "x") == []
    assert names(twin, "MATCH (p:PLC) WHERE p.none != 'x' RETURN p", "p") == ["PLC01"]
    assert names(twin, "MATCH (p:PLC) WHERE p.none < 'a' RETURN p", "p") == ["PLC01"]
    assert names(twin, "MATCH (p:PLC) WHERE p.vendor != 5 RETURN p", "p") == []
    assert names(twin, "MATCH (p:Pump) WHERE p.pressure > 180 AND p.pressure < 190 RETURN p", "p") == ["Pump17"]
    with pytest.raises(ExecutionError):
        bind(twin, parse("MATCH (p:Pump) WHERE q.name = 'x' RETURN p"))


def test_nan_and_first_prop(spark):
    twin = make(spark, [("M", "a", {"x": "nan"}), ("M", "b", {"x": "3"})])
    assert names(twin, "MATCH (m:M) WHERE m.x > 1 RETURN m", "m") == ["b"]
    assert names(twin, "MATCH (m:M) WHERE m.x != 1 RETURN m", "m") == ["a", "b"]
    assert names(twin, "MATCH (m:M) WHERE m.x = 3 OR m.name = 'a' AND m.x < 9 RETURN m", "m") == ["b"]


def test_snapshots(spark):
    twin = make(spark, [("Motor", "M1", {}), ("Pump", "PumpOLD", {}), ("Pump", "PumpNEW", {})], [("M1", "PumpOLD", "mechanical:drives", 0, 500, 0), ("M1", "PumpNEW", "mechanical:drives", 1000, 2000, 0)])
    at = lambda t: names(twin, f"MATCH (m:Motor)-[:mechanical]->(p:Pump) AT {t} RETURN p", "p")
    assert names(twin, "MATCH (m:Motor)-[:mechanical]->(p:Pump) RETURN p", "p") == ["PumpOLD", "PumpNEW"]
    assert at(1500) == ["PumpNEW"] and at(450) == ["PumpOLD"] and at(500) == [] and at(2500) == []


def test_parallel_relations_and_limit(spark):
    twin = make(spark, [("A", "a", {}), ("B", "b", {})], [("a", "b", "t:x", 0, -1, 0)] * 3)
    assert names(twin, "MATCH (a:A)-[:t]->(b:B) RETURN b", "b") == ["b"] * 3
    assert names(twin, "MATCH (a:A)-[:t]->(b:B) RETURN b LIMIT 2", "b") == ["b"] * 2


def test_measures(spark):
    ramp = [(NOW - (600 - i) * 60, 5 + 0.01 * i) for i in range(600)]
    twin = machine(spark, points={"Motor42.current": ramp}).using()
    run = lambda w, items: measure(twin, bind(twin, parse_temporal(f"MATCH (m:Motor) MEASURE m.current DURING {w} RETURN {items}", NOW))).first()
    r = run("last(24h)", "max(current), avg(m.current), count(current), sum(current)")
    assert (round(r["max"], 2), round(r["avg"], 3), r["count"], round(r["sum"], 1)) == (10.99, 7.995, 600.0, 4797.0)
    assert run(f"{NOW - 18000}..{NOW - 14400}", "count(current)")["count"] == 61.0
    r = run("1..2", "max(current), avg(current), count(current), sum(current)")
    assert (r["has_series"], r["max"], r["avg"], r["count"], r["sum"]) == (True, None, None, 0.0, 0.0)
    assert "max" not in run("last(1h)", "max(other)").asDict()
    other = make(spark, [("Motor", "Motor43", {})], points={"X.y": [(1, 1.0)]})
    r = measure(other, bind(other, parse_temporal("MATCH (m:Motor) MEASURE m.current DURING last(1h) RETURN count(current)", NOW))).first()
    assert (r["has_series"], r["count"]) == (False, None)
