"""Strings, rules, JSON lines, containers, models, service and stream."""

import json
from datetime import UTC, datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from graphloom.functions import labels as lb
from graphloom.functions import strings as st
from graphloom.operators import features as ft
from graphloom.plans import service
from graphloom.sources import corpora as co
from graphloom.sources import dictionaries
from graphloom.sources import json_graphs as jg
from graphloom.sources import model_io, records
from graphloom.streaming import serve


def test_rules(spark):
    rules = lb.parse_rules(["# comment", "% too", "", "+.+", "-this", r"-\.num_const", "+this_one"])
    labels = spark.createDataFrame([(x,) for x in ("a", "this", ".num_const", "xnum_const", "this_one", "")], "label string")
    got = {r.label: r.valid for r in lb.valid_labels(labels, rules).collect()}
    assert got == {"a": True, "this": False, ".num_const": False, "xnum_const": True, "this_one": True, "": False}
    with pytest.raises(ValueError):
        lb.parse_rules(["allow this"])


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=some.text(alphabet="ab\\,;:|= \n\t\"()[]né", max_size=12))
def test_escape_round_trip(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(st.escape(F.col("s")).alias("e"), st.unescape(st.escape(F.col("s"))).alias("u")).first()
    assert row.u == text and not set(row.e) & set("\n\t,;:|= \"()[]")


def test_parse_int(spark):
    texts = ["12", " -7\n", "0x1F", "017", "08", "", "9999999999", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(st.parse_int(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [12, -7, 31, 15, None, None, None, None, None]


def test_json_lines(spark, tmp_path):
    good = {"query": [{"a": "x", "b": 7, "f2": "r"}, {"cn": "!=", "n": [7, "x", 7], "group": ["x", 7, 9]}], "assign": [{"v": 7, "inf": "p"}, {"v": 7, "giv": "q"}, {"v": "lost", "giv": "z"}]}
    (tmp_path / "g.json").write_text(json.dumps(good) + "\n\nnot json\n")
    queries, rejected = jg.parse(jg.read_lines(spark, str(tmp_path / "g.json")))
    assert [r.line for r in rejected.collect()] == ["not json"]
    g = jg.tables(queries)
    assert [(r.node, r.label, r.given) for r in g.nodes.collect()] == [(1, "q", True)]
    assert [(r.node_a, r.node_b, r.rel) for r in g.arcs.collect()] == [(0, 1, "r")]
    assert sorted(r.node for r in g.scopes.collect()) == [0, 1]
    assert [r.nodes for r in g.factors.collect()] == [[0, 1, 2]]
    zero = jg.tables(queries, unreferenced_to_zero=True).nodes.collect()
    assert {(r.node, r.label) for r in zero} == {(0, "z"), (1, "q")}


@pytest.mark.parametrize("compress", [False, True])
def test_record_containers(spark, tmp_path, compress):
    rows = [b"", b"a" * 300, bytes(range(256))] + [str(i).encode() for i in range(5000)]
    (tmp_path / "c.rio").write_bytes(records.container(rows, compress))
    got = records.read_containers(spark, str(tmp_path / "c.rio")).orderBy("pos").collect()
    assert [bytes(r.record) for r in got] == rows and [r.pos for r in got] == list(range(len(rows)))
    packed = records.pack_containers(spark.createDataFrame([(r,) for r in rows[:50]], "record binary").coalesce(1), compress=compress).first()
    assert list(records.records(bytes(packed.container))) == rows[:50]


def test_model_round_trip(spark, sf, tmp_path):
    model = ft.count_model(co.orders_graph(spark, sf))
    model_io.save_model(model, str(tmp_path))
    again = model_io.load_model(spark, str(tmp_path))
    for a, b in ((model.pairs, again.pairs), (model.factors, again.factors), (model.label_freq, again.label_freq)):
        assert a.exceptAll(b.select(a.columns)).count() == 0 and a.count() == b.count()


def test_dictionary_keeps_its_ids(spark, tmp_path):
    path, of = str(tmp_path / "d"), lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    ids = lambda: {r.label: r.id for r in dictionaries.load(spark, path).collect()}
    assert ids() == {}
    assert dictionaries.commit(of("b", "d", None, "b"), path, "1") and ids() == {"b": 0, "d": 1}
    assert not dictionaries.commit(of("x"), path, "1") and ids() == {"b": 0, "d": 1}
    (tmp_path / "d" / "batch-2").mkdir()  # a commit that didn't end
    (tmp_path / "d" / "batch-2" / "part-0.parquet").write_bytes(b"")
    assert ids() == {"b": 0, "d": 1}
    assert dictionaries.commit(of("c", "a", "d"), path, "2") and ids() == {"b": 0, "d": 1, "a": 2, "c": 3}
    assert dictionaries.commit(of(), path, "3") and len(ids()) == 4
    got = {r.label: r.label_id for r in dictionaries.with_ids(of("c", None, "z"), dictionaries.load(spark, path)).collect()}
    assert got == {"c": 3, None: None, "z": -1}


def test_log_is_in_utc(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        model_io.append_log(spark.createDataFrame([("x",)], "body string"), str(tmp_path / "log"))
        said = json.loads(next(p for p in (tmp_path / "log").iterdir() if p.name.startswith("part")).read_text())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    at = datetime.strptime(said["time"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
    assert abs((datetime.now(UTC) - at).total_seconds()) < 120


def requests():
    graph = {"query": [{"a": 0, "b": 1, "f2": "turn"}], "assign": [{"v": 0, "inf": "x"}, {"v": 1, "giv": "user"}]}
    ask = lambda i, m, **kw: (i, json.dumps({"jsonrpc": "2.0", "method": m, "params": graph | kw, "id": str(i)}))
    return [ask(1, "infer"), ask(2, "nbest", n=2, infer=False), ask(3, "showgraph"), ask(4, "other"), (5, "{"), ask(6, "nbest"), (7, json.dumps({"jsonrpc": "2.0", "method": "infer", "params": graph}))]


def test_service(spark, sf):
    model = ft.count_model(co.dialog_graph(spark, sf))
    asked = spark.createDataFrame(requests(), "request_id long, body string")
    got = {r.request_id: json.loads(r.response) for r in service.respond(asked, model).collect()}
    assert {i: x["error"]["code"] for i, x in got.items() if "error" in x} == {4: -32601, 5: -32700, 6: -32602}
    assert {x["v"]: x.get("inf", x.get("giv")) for x in got[1]["result"]}[0] != "x" and got[1]["id"] == "1"
    assert len(got[2]["result"][0]["candidates"]) == 2
    assert {n["color"] for n in got[3]["result"]["nodes"]} == {"#6c9ba4", "#96816a"}
    assert 7 not in got
    assert got[4]["error"]["message"] == "Method not found" and got[5]["id"] is None and got[6]["id"] == "6"
    numbered = spark.createDataFrame([(8, requests()[0][1].replace('"id": "1"', '"id": 7')), (9, requests()[3][1].replace('"id": "4"', '"id": 7.5'))], "request_id long, body string")
    assert {r.request_id: json.loads(r.response)["id"] for r in service.respond(numbered, model).collect()} == {8: 7, 9: 7.5}
    late = service.envelopes(asked, version="2").where("request_id = 1").first()
    assert late.code == -31001


def test_service_answers_arrays_and_checks_types(spark, sf):
    model = ft.count_model(co.dialog_graph(spark, sf))
    calls = [json.loads(body) for i, body in requests() if i in (1, 3, 4, 7)]
    bad = [{**calls[0], "params": {**calls[0]["params"], "n": "x"}}, {**calls[0], "jsonrpc": "1.0"}, 5, {**calls[0], "params": {**calls[0]["params"], "infer": 1}}]
    asked = spark.createDataFrame([(1, json.dumps(calls)), (2, json.dumps(bad)), (3, "[]"), (4, json.dumps([calls[3]]))], "request_id long, body string")
    got = {r.request_id: json.loads(r.response) for r in service.respond(asked, model).collect()}
    assert [x.get("id") for x in got[1]] == ["1", "3", "4"] and "nodes" in got[1][1]["result"] and got[1][2]["error"]["code"] == -32601
    assert [x["error"]["code"] for x in got[2]] == [-32602, -32600, -32600, -32602]
    assert got[3]["error"]["code"] == -32600 and 4 not in got


def test_equal_lines_are_different_records(spark, tmp_path):
    line = json.dumps({"query": [{"a": 0, "b": 1, "f2": "r"}], "assign": [{"v": 0, "inf": "p"}, {"v": 1, "giv": "q"}]})
    (tmp_path / "g.json").write_text("\n".join([line] * 3))
    g = jg.tables(jg.parse(jg.read_lines(spark, str(tmp_path / "g.json")))[0])
    assert g.arcs.count() == 3 and {r.n_queries for r in ft.label_frequency(g.nodes).collect()} == {3}


def test_stream(spark, sf, tmp_path):
    model = ft.count_model(co.dialog_graph(spark, sf))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.txt").write_text("\n".join([body for _, body in requests()[:4]] + [requests()[0][1]]))  # one of them twice
    serve.serve(serve.read_requests(spark, str(tmp_path / "in")), model, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out" / "replies")).count() == 5
