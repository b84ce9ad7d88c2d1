"""The trace operators: every query with SQL against DuckDB, kernels on small cases, streaming against replay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracefold.functions import decide as D
from tracefold.functions import text as T
from tracefold.operators import compress as C
from tracefold.operators import filler as L
from tracefold.operators import graph as G
from tracefold.operators import memory as M
from tracefold.operators import tools as X
from tracefold.plans import queries as Q
from tracefold.sources import traces as S
from tracefold.streaming import rescue as R

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
MSG = "trace_id string, msg_idx int, role string, content string, tool_name string, tool_args string"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canon(rows):
    def f(v):
        return "null" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(f(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert canon(got.select(*cols).collect()) == canon(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(Q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def trace(spark, *rows):
    return spark.createDataFrame([("t", i, r, c, *(x or [None, None])) for i, (r, c, *x) in enumerate(rows) for x in [x[0] if x else None]], MSG)


# --- sources


def test_ragged_messages_are_normalised(spark):
    body = {"turns": [{"role": "user", "content": "a"}, {"sender": "bot", "content": [{"type": "text", "text": "b"}, {"type": "image"}, {"type": "text", "text": "c"}]}, "bare", {"speaker": " ", "content": {"text": "d"}}, {"from": "x", "text": "e", "tool_calls": [{"function": {"name": "f", "arguments": "{\"k\":1}"}}]}, None, {"content": None}]}
    raw = spark.createDataFrame([("1", json.dumps(body)), ("2", json.dumps(body["turns"][:1])), ("3", "no json"), ("4", "{\"other\": []}"), ("5", None)], "trace_id string, body string")
    got = S.from_json(raw).orderBy("trace_id", "msg_idx").collect()
    assert [(r.role, r.content) for r in got if r.trace_id == "1"][:5] == [("user", "a"), ("bot", "b c"), ("assistant", "bare"), ("assistant", "d"), ("x", "e")]
    assert got[4].tool_name == "f" and got[4].tool_args == '{"k":1}' and {r.trace_id for r in got} == {"1", "2"}


def test_store_and_reports(spark, tmp_path):
    m = trace(spark, ("user", "hello"), ("assistant", "world"))
    store = S.MessageStore(spark, str(tmp_path / "s"))
    store.save(m)
    store.save(m.where("msg_idx = 0").withColumn("content", F.lit("again")))
    assert [r.content for r in store.get("t").orderBy("msg_idx").collect()] == ["again", "world"] and store.get("t", 1).count() == 1
    assert {r.content for r in store.resolve(m.withColumn("content", F.lit("x"))).collect()} == {"again", "world"}
    for kind in ("json", "csv", "md", "html"):
        S.write_report(m.select("trace_id", "msg_idx"), str(tmp_path / kind), kind)
    assert (tmp_path / "md").read_text().startswith("| trace_id |") and "<td>t</td>" in (tmp_path / "html").read_text()
    assert json.loads(S.to_json(m).first().body)[1]["content"] == "world"


# --- text


@pytest.mark.parametrize("value,text,ok", [("12", "a 12 b", True), ("12", "a 123 b", False), ("Abc", "x abc.", True), ("abc", "abcd", False), ("ORD-1", "the ord 1!", True), ("", "x", False), ("50%", "at 50 %", True)])
def test_recoverable_in_both_forms(spark, value, text, ok):
    df = spark.createDataFrame([(value, text)], "v string, t string")
    assert df.select(T.recoverable(F.col("v"), F.col("t"))).first()[0] == ok == D.readable(value, text)


# --- decisions


@pytest.mark.parametrize(
    "role,content,tool,before,want",
    [
        ("assistant", "I recommend ORDER-000123 because it is cheaper.", None, None, ("judgment", "recommend", "ORDER-000123")),
        ("assistant", "Confirmed. ORDER-000123 has been cancelled.", None, None, ("confirmation", "confirm", "ORDER-000123")),
        ("assistant", "", "get_order", None, ("action", "get_order", "")),
        ("user", "Could you cancel ORDER-000123?", None, None, ("judgment", "cancel", "ORDER-000123")),
        ("user", "B", None, "Which option do you want?", ("judgment", "decide", "")),
        ("assistant", "We did not approve it.", None, None, None),
        ("assistant", "Should we approve it?", None, None, None),
        ("assistant", "Perhaps we approve it.", None, None, None),
        ("user", "Cancela ORDER-000999", None, None, ("judgment", "cancel", "ORDER-000999")),
        ("assistant", "I'm certain the answer is 42.", None, None, ("confirmation", "confirm", "42")),
        ("user", "Nice weather", None, None, None),
        ("user", None, None, None, None),
    ],
)
def test_builders(role, content, tool, before, want):
    d = D.decide(role, content, tool, None, before)
    assert (d and (d["kind"], d["action"], d["target"])) == want


def test_match_scores():
    d = {"action": "cancel", "target": "ORDER-000123", "rationale": []}
    assert D.match(d, d)["reproduced"] and D.match(d, d)["overall"] == 1
    assert D.match(d, d | {"action": "cancelled"})["action"] >= 0.95
    assert not D.match(d, d | {"target": "ORDER-000124"})["reproduced"] and not D.match(d, None)["reproduced"]


# --- compression


def order_trace(k=1):
    return [{"trace_id": "t", "msg_idx": i, "role": r, "content": c, "tool_name": None, "tool_args": None} for i, (r, c) in enumerate([("system", "You are an order agent."), ("user", f"Please cancel ORDER-00{k:04d}."), ("assistant", "Let me look. " + "This is some talk without any weight. " * 30), ("tool", '[{"line":1}]'), ("assistant", f"Confirmed. ORDER-00{k:04d} has been cancelled. Refund of $123.45 is processed. " + "Have a nice day out there. " * 20), ("user", "Thanks.")])]


def test_compression_keeps_values_and_order():
    rows = order_trace()
    short = C.compress_trace(rows)
    assert [r["msg_idx"] for r in short] == sorted(r["msg_idx"] for r in short)
    s = C.score_trace(rows, short)
    assert s["missing"] == 0 and s["reduction"] > 0.6 and s["retention"] == 1
    assert C.score_trace(rows, rows)["drr_binary"] == 1
    assert C.score_trace(rows[:1], rows[:1])["drr_soft"] is None
    assert C.compress_trace([]) == []


def test_batches_cut_at_traces(spark):
    rows = [r | {"trace_id": f"t{k}"} for k in range(300) for r in order_trace(k)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], MSG)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = C.evaluate(df, ("compress", "identity")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 600 and {r.missing for r in got} == {0}
    board = {r.method: r["rank"] for r in C.leaderboard(spark.createDataFrame(got)).collect()}
    assert board == {"compress": 1, "identity": 2}
    assert {r.robust for r in C.adversarial(df).collect()} <= {True, False} and C.frontier(df).count() == 4


def test_statistics():
    assert C.bootstrap([0.5] * 10)["low"] == 0.5 and C.bootstrap([1.0])["low"] != C.bootstrap([1.0])["low"]
    assert C.cohen_d([1, 2, 3], [1, 2, 3]) == 0 and C.wilcoxon([1, 2, 3], [1, 2, 3])["p"] == 1
    rng = random.Random(0)
    a = [rng.random() for _ in range(40)]
    assert C.wilcoxon([x + 0.5 for x in a], a)["p"] < 1e-4


# --- tools, memory, filler


def test_listing_is_compacted():
    text = json.dumps([{"id": i, "state": "open", "note": None} for i in range(6)])
    short = X.compact_listing(text)
    assert len(short) < len(text) and "state=open" in short and short.endswith("5")
    assert X.compact_listing("[1, 2]") == "[1, 2]" and X.compact_listing("no") == "no"
    assert json.loads(X.rescalarise(json.dumps([{"a": i, "b": [1]} for i in range(6)])))[5] == {"a": 5}


def test_runs_and_duplicates(spark):
    call = ["f", "{}"]
    m = trace(spark, *[x for _ in range(4) for x in (("assistant", "", call), ("tool", "the same long result " * 3))])
    assert X.call_runs(m).first().calls == 4 and X.dedupe_results(m).count() == 3
    assert [r.content for r in X.collapse_runs(m).orderBy("msg_idx").collect()][2] == "[2 more 'f' calls]"


def test_lifecycle_and_recall(spark):
    m = trace(spark, ("user", "I want to migrate billing database"), ("assistant", "Billing is done"), ("user", "I want to paint walls"), ("user", "never mind the walls"))
    assert [r.status for r in M.lifecycle(m, M.anchors(m)).where("kind = 'goal'").orderBy("msg_idx").collect()] == ["completed", "abandoned"]
    facts = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "red car and red bus")], "fact_id long, text string")
    assert [r.fact_id for r in M.tfidf_recall(facts, "red bus", 2).orderBy("rank").collect()] == [3, 1] and M.tfidf_recall(facts, "", 2).count() == 0


def test_filler_is_pruned(spark):
    m = trace(spark, ("assistant", "Sure. The total is 5"), ("assistant", "Sure. Let me know"), ("tool", "Sure. x"))
    lab = spark.createDataFrame([("sure", True)] * 9 + [("total 5", False)] * 9, "clause string, is_filler boolean")
    got = [r.content for r in L.prune(m, L.filler_weights(lab)).orderBy("msg_idx").collect()]
    assert got == ["The total is 5", "Let me know", "Sure. x"]


def test_graph_of_a_chain(spark):
    m = trace(spark, ("user", "see AB-1111"), ("assistant", "AB-1111 gives AB-2222"), ("assistant", "AB-2222 gives AB-3333"), ("assistant", "use AB-3333"))
    a = G.artifacts(m, T.LINKING)
    assert {(r.node, r.ancestor) for r in G.ancestors(G.causal_edges(a)).collect()} == {(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)}


# --- streaming


def test_stream_is_replay(spark, tmp_path):
    m = S.from_orders(S.table(spark, SF, "orders").where("o_orderkey % 100 = 1"), S.table(spark, SF, "lineitem"))
    m = m.unionByName(m.where("msg_idx = 4").withColumn("msg_idx", F.lit(5)).withColumn("role", F.lit("user")).withColumn("content", F.concat(F.lit("again "), "content")))
    want = sorted(map(tuple, R.replay(m).collect()), key=str)
    assert any(r[5] for r in want)
    for i in range(6):
        m.where(F.col("msg_idx") == i).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = R.stream(spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), ttl=None)
    w = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    w.awaitTermination(300)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*R._FIELDS).collect()), key=str) == want


def test_windowed_rollup(spark):
    e = S.table(spark, SF, "events")
    got = R.rollup(e)
    assert got.agg(F.sum("calls")).first()[0] == e.count()
