"""Canonical JSON, setup identities and condition tables against values made by plain Python."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from barflow.functions import canonical as J
from barflow.operators import conditions as C
from barflow.operators import logstats as G

ODD = ["", "plain", 'quote " back \\ slash /', "tab\tnew\nreturn\r\b\f\x00\x1f\x7f", "é ü 中 😀  ", "  both ends  \x1c", "İK"]


def digest(value, n=16):
    return hashlib.sha256(value.encode()).hexdigest()[:n]


def test_json_text_is_that_of_the_library(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    got = {r.i: r for r in rows.select("i", J.json_text(F.col("t")).alias("j"), J.json_array(F.array("t", F.lit("b"))).alias("a"), J.stripped(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(ODD):
        assert got[i].j == json.dumps(t) and got[i].a == json.dumps([t, "b"], separators=(",", ":")) and got[i].s == t.strip()
    same = spark.createDataFrame([('{"b": 1, "a": [2, {"d": "x", "c": null}]}',), ('{"a":[2,{"c":null,"d":"x"}],"b":1}',), ("no json",), (None,)], "t string")
    assert [r[0] for r in same.select(J.json_reordered(F.col("t"))).collect()] == ['{"a":[2,{"c":null,"d":"x"}],"b":1}'] * 2 + ["no json", None]


SETUPS = "bar_config string, theme_tag string, entry_conditions array<struct<feature:string,column:string,op:string,operator:string,role:string>>, params string, entry_logic string"


def test_setup_keys_by_hand(spark):
    many = [("z", None, ">", None, "primary"), (None, "y", None, "between", " Confirmation"), ("x", "", "bool_true", "", None), ("", "", "<", None, "primary"),
            ("w", None, "", "", "primary"), ("v\"é", None, "<=", None, "PRIMARY")]
    rows = [(" tick_610 ", "  Big -- Theme__x! ", many, '{"stop_loss": 1, "n": 2, "pt_ticks": 3}', " Buy: the DIP! "), (None, None, None, None, None), ("b", "", [], "[1]", "?!")]
    got = G.setup_identity(spark.createDataFrame(rows, SETUPS)).select("setup_key", "setup_label").collect()
    one = {"bar_config": "tick_610", "theme_tag": "big_theme_x", "condition_count": 4, "exit_profile": ["pt_ticks", "stop_loss"], "direction_logic_hash": digest("buy the dip", 12),
           "conditions": [{"feature": 'v"é', "operator": "<=", "role": "primary", "kind": "compare"}, {"feature": "x", "operator": "bool_true", "role": "confirmation", "kind": "boolean"},
                          {"feature": "y", "operator": "between", "role": "confirmation", "kind": "between"}, {"feature": "z", "operator": ">", "role": "primary", "kind": "compare"}]}
    bare = {"bar_config": "", "theme_tag": "unknown", "condition_count": 0, "exit_profile": [], "direction_logic_hash": "", "conditions": []}
    for r, signature in zip(got, (one, bare, {**bare, "bar_config": "b"})):
        assert r.setup_key == "setup_" + digest(json.dumps(signature, sort_keys=True, separators=(",", ":")))
    assert got[0].setup_label == 'tick_610 | v"é <= (primary), x bool_true (confirmation), y between (confirmation), +1 more | exit=pt_ticks,stop_loss'
    assert got[1].setup_label == "unknown_bar | no_conditions | exit=basic_exit"


def test_task_setups_by_hand(spark):
    rows = [(" k ", "", None, "b", "s", "{}"), (None, None, ("from", "Label"), "b", "s", "{}"), ("", "", None, " b", None, '{"z":1,"a":2}'), ("  ", None, ("x", None), "", "s", None)]
    df = spark.createDataFrame(rows, "setup_key string, setup_label string, source struct<setup_key:string,setup_label:string>, bar_config string, strategy_name string, params string")

    def fallback(bar, name, keys):
        return "setup_" + digest(json.dumps({"bar_config": bar, "strategy_name": name, "param_keys": keys}, sort_keys=True, separators=(",", ":")))
    assert [tuple(r) for r in G.task_setup(df).select("setup_key", "setup_label").collect()] == [
        ("k", "k"), ("from", "Label"), (fallback("b", "", ["a", "z"]), "b | unknown_strategy"), (fallback("", "s", []), "unknown_bar | s")]


COND = "brief string, pos int, feature string, op string, role string, param_key string, param_key_low string, param_key_high string, value double, low double, high double"


def condition(brief, pos, feature, op, role="primary", value=None, low=None, high=None, key="k"):
    return (brief, pos, feature, op, role, key, "lo", "hi", value, low, high)


def test_rules_of_condition_tables(spark):
    rows = [condition("ok", 0, "f", ">", value=1.0), condition("ok", 1, "f", ">", "confirmation", 1.0), condition("no_value", 0, "f", ">"),
            condition("no_bounds", 0, "f", "between", low=1.0), condition("inverted", 0, "f", "between", low=2.0, high=1.0), condition("no_key", 0, "f", "<", value=1.0, key=" "),
            condition("twice", 0, "f", "bool_true"), condition("twice", 1, "f", "bool_true"), condition("other_key", 0, "f", ">", value=1.0), condition("other_key", 1, "f", ">", value=2.0, key="m"),
            *[condition("three", i, f"f{i}", "bool_true") for i in range(3)], condition("odd", 0, "f", "!="), condition("empty", 0, " ", "bool_true"), condition("blank_role", 0, "f", "bool_true", "")]
    got = {r.brief: r for r in C.check_conditions(spark.createDataFrame(rows, COND), ["brief"]).collect()}
    assert {b for b, r in got.items() if r.valid} == {"ok", "other_key", "blank_role"}
    assert got["twice"].duplicate_count == 1 and got["three"].primary_count == 3 and got["no_bounds"].missing_value_count == got["no_key"].missing_value_count == 1
    slop = [condition("a", 0, "f", "bool_true", "Location_Filter"), condition("a", 1, "f", "bool_true", "primary"), condition("a", 2, "g", "bool_true", "my_timing"),
            condition("a", 3, "h", "bool_true", "odd_filter"), condition("a", 4, "i", "<", "odd_filter", 1.0), condition("a", 5, "j", "<", "anchor x", 1.0)]
    kept = [(r.pos, r.role) for r in C.coerce_conditions(spark.createDataFrame(slop, COND)).orderBy("pos").collect()]
    assert kept == [(0, "primary"), (2, "confirmation"), (4, "primary")]


def test_many_briefs_in_turns_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(C, "BRIEFS", 7)
    rng, nan = random.Random(3), float("nan")
    data = [(f"s{i % 3}", rng.choice([None, nan, float("inf"), *[float(v) for v in range(5)]]), float(rng.randrange(5))) for i in range(200)]
    bars = spark.createDataFrame(data, "sample string, x double, y double").withColumn("prev_day_z", F.lit(nan))
    rows = []
    for b in range(30):
        for p in range(rng.randint(1, 3)):
            low = float(rng.randrange(4))
            rows.append(condition(f"b{b}", p, rng.choice(["x", "y", "x", "y", "gone", "prev_day_z"]), rng.choice(C.OPS), rng.choice(C.ROLES), float(rng.randrange(5)), low, low + rng.randrange(3), key=f"k{p}"))

    def holds(v, c):
        if v is None or v != v or abs(v) == float("inf"):
            return False
        _, _, _, op, _, _, _, _, value, low, high = c
        return {">": v > value, ">=": v >= value, "<": v < value, "<=": v <= value, "between": low <= v <= high, "bool_true": v > 0.5, "bool_false": v <= 0.5}[op]

    def cell(row, c):
        return {"x": row[1], "y": row[2]}.get(c[2])
    got = {(r.sample, r.brief, r.pos): r for r in C.feasibility(bars, spark.createDataFrame(rows, COND), ["sample"]).collect()}
    assert len(got) == 3 * len(rows)
    for s in ("s0", "s1", "s2"):
        own = [r for r in data if r[0] == s]
        for c in rows:
            brief = [d for d in rows if d[0] == c[0]]
            r, both = got[s, c[0], c[1]], sum(all(holds(cell(v, d), d) for d in brief) for v in own)
            n = sum(holds(cell(v, c), c) for v in own)
            assert (r.pass_count, r.combined_count, r.total_count) == (n, both, len(own))
            dead = [d for d in brief if d[2] in ("gone", "prev_day_z")]
            want = ("context_unavailable" if any(d[2] == "prev_day_z" for d in dead) else "dead_feature_primary" if any(d[4] == "primary" for d in dead)
                    else "zero_signal" if not both else "over_signal" if 100 * both / len(own) > 2 else "ok")
            assert r.status == want
            assert r.severity == ("dead_feature" if c[2] == "gone" else "context_unavailable" if c[2] == "prev_day_z" else "blocks_all" if not n else "restrictive" if 100 * n / len(own) < 1 else "normal")


def test_thresholds_that_must_stay(spark):
    q = (0.0, 1.0, 2.0, 3.0, 4.0)
    rows = [("zero_signal", ">", "k", "", "", 5.0, None, None, *q), ("zero_signal", ">", "sl_ticks_1", "", "", 5.0, None, None, *q), ("zero_signal", "between", "", "a", "b", None, 0.0, 9.0, *q),
            ("zero_signal", "between", "", "a", "b", None, 2.0, 2.5, *q), ("over_signal", "between", "", "a", "pt_ticks", None, -9.0, 9.0, *q),
            ("over_signal", "between", "", "a", "b", None, -9.0, 9.0, *q), ("over_signal", "between", "", "a", "b", None, 2.9, 9.0, *q), ("over_signal", ">=", "k", "", "", 4.0, None, None, *q),
            ("over_signal", "between", "", "a", "b", None, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("ok", ">", "k", "", "", 5.0, None, None, *q)]
    df = spark.createDataFrame(rows, "status string, op string, param_key string, param_key_low string, param_key_high string, value double, low double, high double, "
                                     "p02 double, p10 double, p50 double, p90 double, p98 double")
    assert [(r.new_value, r.new_low, r.new_high) for r in C.suggest_thresholds(df).collect()] == [
        (3.0, None, None), (None, None, None), (None, None, None), (None, 1.0, 3.0), (None, None, None), (None, 1.5, 2.5), (None, 1.75, 2.25), (4.25, None, None),
        (None, 0.999999, 1.000001), (None, None, None)]
