"""Rejects, orphans and skewed labels against plain versions, with hard rows."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions.labels import normal_form
from loomgraph.operators import orphans, skew
from loomgraph.sources import rejects
from tests.labels import EDGE_SCHEMA, normal

HARD = [None, "", " ", "​", "﻿ \t", "a", "A-b", " a__b ", "ｓｅaled by", "x y", "\r\nQ\f", "-", "_x_", "ﬁn", "a" * 5000, "İ", "é", "é", "a‐b", "a b"]


def test_normal_form(spark):
    got = spark.createDataFrame([(i, x) for i, x in enumerate(HARD)], "i int, x string").select("i", normal_form(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in got} == {i: normal(x) for i, x in enumerate(HARD)}


def _edges(spark, rows):
    return spark.createDataFrame(rows, EDGE_SCHEMA)


T0 = dt.datetime(2024, 1, 1)


def _edge(i, s, t, d, w=1.0, split="train", source="x", loaded=T0):
    return (i, s, t, d, w, split, source, T0, loaded)


def test_label_stats_hot_key_and_copies(spark):
    rng = random.Random(1)
    rows = [_edge(i, "Hot", "t", f"n{rng.randrange(300)}", 0.5) for i in range(1000)] + [_edge(i, "hot ", "t", "n1", None) for i in range(500)]
    rows += [_edge(i, f"s{i % 50}", None, rng.choice([None, "", "n1", "N1"]), 1.5) for i in range(500)]
    got = {(r.field, r.term): (r.n_edges, r.n_neighbours, r.sum_weight) for r in skew.label_stats(_edges(spark, rows), share=0.1).collect()}
    want = {}
    for at, to, name in ((1, 3, "src_column"), (3, 1, "dst_column")):
        for r in rows:
            if (x := normal(r[at])) is not None:
                n, near, w = want.setdefault((name, x), [0, set(), None])
                near.add(normal(r[to]))
                want[name, x] = [n + 1, near, w if r[4] is None else (w or 0) + r[4]]
    assert got == {k: (n, len(near - {None}), w) for k, (n, near, w) in want.items()}
    spread = skew.heavy_labels(_edges(spark, rows), ("src_column",), 0.1).collect()
    assert [(r.field, r.term) for r in spread] == [("src_column", "hot")]


def test_label_stats_empty_and_clashing_names(spark):
    assert skew.label_stats(_edges(spark, [])).count() == 0
    e = _edges(spark, [_edge(1, "a", "t", "b")]).select("*", F.lit("x").alias("SRC_COLUMN"), F.lit(1).alias("salt"), F.lit(1).alias("salt"), F.lit("q").alias("field"), F.lit("q").alias("term"))
    assert skew.label_stats(e).count() == 2


def _mapping(spark, rows, label="node_label", key="node_id"):
    return spark.createDataFrame(rows, f"{label} string, {key} bigint, mapped_at timestamp_ntz, removed_at timestamp_ntz")


def _found(spark, edges, nodes, rels):
    return {(r.ref_id, r.field) for r in orphans.edge_list_orphans(_edges(spark, edges), _mapping(spark, nodes), _mapping(spark, rels, "relation_label", "relation_id")).collect()}


def _h(k):
    return T0 + dt.timedelta(hours=k)


def test_orphans_boundaries(spark):
    nodes = [("A", 1, _h(0), _h(5)), ("a", 1, _h(0), _h(5)), ("a", 2, _h(8), None), ("b", 3, _h(2), _h(1)), ("c", 4, None, None), ("", 5, _h(0), None)]
    rels = [("T", 1, _h(0), None)]
    edges = [_edge(k, "a", "t", "a", loaded=_h(k)) for k in range(10)]
    edges += [_edge(20, "b", "t", "c", loaded=_h(3)), _edge(21, None, None, "", loaded=_h(3)), _edge(22, "a", "u", "a", loaded=None), _edge(None, "zz", "t", "a", loaded=_h(9))]
    want = {(k, f) for k in (5, 6, 7) for f in ("src_column", "dst_column")} | {(20, "src_column"), (20, "dst_column"), (22, "src_column"), (22, "edge_type_column"), (22, "dst_column"), (None, "src_column")}
    assert _found(spark, edges, nodes, rels) == want
    assert _found(spark, edges, [], []) >= {(0, "src_column"), (0, "edge_type_column")}
    assert _found(spark, [], nodes, rels) == set()


def test_orphans_in_batches_equal_one_batch(spark):
    rng = random.Random(3)
    refs = spark.createDataFrame([("p", "f", f"k{rng.randrange(6)}", i, _h(rng.randrange(40))) for i in range(300)], "parent string, field string, label string, ref_id bigint, at timestamp_ntz")
    events = spark.createDataFrame([("p", f"k{k}", _h(t), d) for k in range(5) for t, d in ((3 + k, 1), (12 + k, -1), (25, 1))], "parent string, label string, at timestamp_ntz, delta bigint")
    whole = {r.ref_id for r in orphans.orphans_at_load(refs, events).collect()}
    heavy = spark.createDataFrame([("p", "k0"), ("p", "k1")], "parent string, label string")
    assert {r.ref_id for r in orphans.orphans_at_load(refs, events, heavy).collect()} == whole
    spans = [(None, str(_h(10))), (str(_h(10)), str(_h(20))), (str(_h(20)), None)]
    state, known = None, None
    for r, e, until in orphans.batches(refs, events, spans):
        known = orphans.step(known, r, e, until, heavy)
        state = orphans.advance(state, r, e)
    found = {x.ref_id for x in known.waiting.collect()}
    assert found == whole
    assert {tuple(r) for r in state.collect()} == {tuple(r) for r in orphans.advance(None, refs, events).collect()}
    assert [r.n_labels for r in orphans.pending(state).collect()] == [1]  # k5 never came


def test_late_orphans_and_parents(spark):
    """Batches that don't follow time: late parents resolve, late removals reopen, late references probe their own time."""
    rng = random.Random(8)
    refs = spark.createDataFrame([("p", "f", f"k{rng.randrange(6)}", i, _h(rng.randrange(40))) for i in range(300)] + [("p", "f", "k0", 999, None)], "parent string, field string, label string, ref_id bigint, at timestamp_ntz")
    events = spark.createDataFrame([("p", f"k{k}", _h(t), d) for k in range(5) for t, d in ((3 + k, 1), (12 + k, -1), (25, 1))], "parent string, label string, at timestamp_ntz, delta bigint")
    whole = {r.ref_id for r in orphans.orphans_at_load(refs, events).collect()}
    state, until = None, ""
    for part in range(3):
        r, e = refs.filter(F.pmod(F.hash("ref_id"), F.lit(3)) == part), events.filter(F.pmod(F.hash("label", "at"), F.lit(3)) == part)
        until = max(until, str(_h(41)))
        state = orphans.step(state, r, e, until)
    found = [x.ref_id for x in state.waiting.collect()]
    assert len(found) == len(set(found)) and set(found) == whole


def test_snapshots_in_batches(spark):
    rng = random.Random(4)
    day = lambda k: T0 + dt.timedelta(days=k)
    refs = spark.createDataFrame([("p", "f", f"k{rng.randrange(9)}", i, day(rng.randrange(400))) for i in range(500)], "parent string, field string, label string, ref_id bigint, at timestamp_ntz")
    events = spark.createDataFrame([("p", f"k{k}", day(t), d) for k in range(8) for t, d in ((30 + 20 * k, 1), (120 + 25 * k, -1), (350, 1))], "parent string, label string, at timestamp_ntz, delta bigint")
    once = {tuple(r) for r in orphans.pending_snapshots(refs, events).collect()}
    month = lambda k: str(day(k).replace(day=1, hour=0, minute=0, second=0))
    spans = [(None, month(100)), (month(100), month(250)), (month(250), None)]
    assert {tuple(r) for r in orphans.pending_snapshots(refs, events, spans).collect()} == once and len(once) > 10


LAYOUTS = [(0, "a", "train", " ", 0, 3, 0, 1, 2, None), (1, "b", "train", ",", 1, 5, 1, 2, 3, 4), (2, "c", "test", ";", 0, 3, 0, None, 1, 2), (3, "d", "test", None, 0, 3, 0, 1, 2, None), (4, "e", "test", "|", 0, 2, 0, 1, 5, None)]
FILES = "file_id int, file_name string, split string, delim string, header_length int, n_columns int, src_column int, edge_type_column int, dst_column int, edge_weight_column int"
RAW = "line_id bigint, file_id int, line_no bigint, raw_line string, received_at timestamp_ntz"


def _fields(line, d):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, v = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] != '"':
                        break
                    j += 1
                v += line[j]
                j += 1
            j += 1
            if j < len(line) and line[j] != d:
                return None
        else:
            j = line.find(d, i)
            j = len(line) if j < 0 else j
            v = line[i:j]
            if '"' in v:
                return None
        out.append(v)
        if j >= len(line):
            return out
        i = j + 1


def _plain(line, layout):
    """Whether a line is valid, in plain steps."""
    import re

    if line is None or layout is None:
        return False
    _, _, _, delim, _, n, s, t, d, w = layout
    if not delim or any(p is not None and p >= n for p in (s, t, d, w)):
        return False
    v = _fields(line[:-1] if line.endswith("\r") else line, delim)
    if v is None or len(v) != n:
        return False
    ok = all(re.fullmatch(r"[a-z]+_[a-z]+_[0-9a-z]+", normal(v[p]) or "") for p in (s, d))
    if ok and t is not None:
        ok = re.fullmatch(r"[a-z]+(_[a-z]+)*", normal(v[t]) or "")
    if ok and w is not None:
        x = v[w].strip(" \t")
        ok = x == "" or (re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", x) and abs(float(x)) != float("inf"))
    return bool(ok)


LINES = [
    (1, 'x,a_b_c,t,a_b_d,1'), (1, 'x,"a_b_c",t,a_b_d,"1"'), (1, '"say ""hi"", you",a_b_c,t,a_b_d,'), (1, 'x,a_b_c,t,a_b_d'), (1, 'x,a_b_c,t,a_b_d,1,2'), (1, 'x,a"b,t,a_b_d,1'), (1, 'x,a_b_c,t,"a_b_d,1'),
    (1, 'x,a_b_c,"t"u,a_b_d,1'), (1, 'a"b,"a_b_c,t,a_b_d,1'), (1, ' "x",a_b_c,t,a_b_d,1'), (1, 'x,a_b_c,t,a_b_d,1e999'), (1, 'x,a_b_c,t,a_b_d,\t.5e-3 '), (1, 'x,a_b_c,t,a_b_d,nan'), (1, 'x,a_b_c,t,a_b_d,1_0'),
    (1, 'x,a_b_c,t,a_b_d,"1"\r'), (1, 'x,a_b_c,t,a_b_d,1\r\r'), (1, ''), (1, None), (1, 'x\ny,a_b_c,t,a_b_d,1'), (1, '"x\ny",a_b_c,"t\nu",a_b_d,1'), (1, 'x\0,a_b_c,t,a_b_d,1'), (1, 'x,a\0_b_c,t,a_b_d,1'), (1, '","'), (1, '"'), (1, '""'),
    (1, 'x,a_b_c,t,a_b_d,"'), (1, 'y' * 3_000_000 + ',a_b_c,t,a_b_d,1'), (1, '"' + 'z' * 50_000 + '",a_b_c,t,a_b_d,1'), (0, 'a_b_c t a_b_d'), (0, '"a b c" t a_b_d'), (0, 'a_b_c  a_b_d'), (0, 'Ａ_b_c t a-b-d'), (0, 'a_b_c t a_b_d '),
    (2, 'a_b_c;a_b_d;'), (2, 'a_b_c;a_b_d;+3.'), (2, '3;a_b_d;1'), (3, 'a b c'), (4, 'a|b'), (9, 'a b c'), (1, 'x,a_b_c,t,a_b_d,\x02"'), (1, '\x02'), (1, 'x,a_b_c,t,a_b_d,\x01'), (1, '0,1,a_b_c,t,a_b_d,1'),
]


def test_rejects_hard_lines(spark):
    files = spark.createDataFrame(LAYOUTS, FILES)
    raw = spark.createDataFrame([(i, f, i + 1, line, None) for i, (f, line) in enumerate(LINES)], RAW)
    got = {r.line_id: r for r in rejects.read_lines(raw.repartition(1), files).collect()}
    by = {x[0]: x for x in LAYOUTS}
    for i, (f, line) in enumerate(LINES):
        assert (got[i].reason is None) == _plain(line, by.get(f)), (line, got[i])
    assert got[4].reason == "column_count" and got[6].reason == "broken_quoting" and got[17].reason == "null_line" and got[36].reason == "no_layout"
    assert (got[1].src, got[1].edge_type, got[1].dst, got[1].weight) == ("a_b_c", "t", "a_b_d", 1.0)
    assert got[34].weight == 3.0 and got[34].edge_type is None


def test_rejects_headers_nulls_and_empty(spark):
    files = spark.createDataFrame(LAYOUTS, FILES)
    raw = spark.createDataFrame([(1, 1, 0, "h", None), (2, 1, None, "h", None), (3, None, 5, "h", None), (None, 1, 7, "x,a_b_c,t,a_b_d,1", None), (5, 1, 7, "x,a_b_c,t,a_b_d,1", None), (5, 1, 7, "x,a_b_c,t,a_b_d,1", None)], RAW)
    wide = raw.select("*", F.lit(1).alias("delim"), F.lit("x").alias("RAW_LINE"), F.lit("y").alias("src"))
    assert sorted((r.line_id or 0, r.reason or "") for r in rejects.read_lines(wide, files).collect()) == [(0, ""), (2, "column_count"), (3, "no_layout"), (5, ""), (5, "")]
    assert rejects.read_lines(raw.limit(0), files).count() == 0
    assert rejects.read_lines(raw, files.limit(0)).filter("reason = 'no_layout'").count() == 6


def _file(lines, n=3, positions=(0, None, 1, None)):
    import duckdb

    con = _con.setdefault("c", duckdb.connect(config={"threads": 1}))
    out, error, bad = [{}, {}, {}, {}], [None] * len(lines), set()
    rejects._file(con, list(enumerate(lines)), ",", n, positions, out, error, bad)
    return out, error, bad


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='a_b",x1 \n\r', max_size=14), min_size=1, max_size=12))
def test_reader_matches_plain_fields(lines):
    out, error, _ = _file(lines)
    for i, x in enumerate(lines):
        v = _fields(x, ",")
        assert (error[i] is None) == (v is not None and len(v) == 3), (x, error)
        if error[i] is None:
            flat = lambda y: y.replace("\n", "\x0b").replace("\r", "\x0b")
            assert [flat(f[i]) for f in (out[0], out[2])] == [flat(y) for y in v[:2]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="0123459+-.eE_xnaifINFtd \t\r\x0b", max_size=7), min_size=1, max_size=12))
def test_reader_matches_weight_format(weights):
    import math
    import re

    out, error, bad = _file([f"a,b,{w}" for w in weights], 3, (0, None, 1, 2))
    for i, w in enumerate(weights):
        x = w.strip(" \t")
        ok = x == "" or (re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?", x) and math.isfinite(float(x)))
        assert error[i] is None and (i not in bad) == bool(ok), (w, out[3].get(i))
        if ok:
            assert out[3].get(i) == (float(x) if x else None)


_con: dict = {}


@pytest.mark.parametrize("line,ok", [('a,"b",c', True), ('a,b"c', False), ('"a""b"', True), ('"a"b"', False), ("", True), ('""', True), ('"', False)])
def test_quotes_hold(line, ok):
    assert (rejects._split(line, ",") is not None) is ok
