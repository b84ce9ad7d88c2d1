"""Faults that the findings of round 3 name, each on a small case."""

import json
import math
import re

import numpy as np

from tracefold.functions import decide as D
from tracefold.functions import language
from tracefold.operators import compress as C
from tracefold.operators import filler as L
from tracefold.operators import graph as G
from tracefold.operators import tools as X
from tracefold.plans import queries as Q


def test_numbers_of_other_lengths_are_of_one_shape():
    rows = [{"line": i, "part": f"PART-{p}"} for i, p in enumerate((999, 12345, 1000, 99999, 7, 54321))]
    short = X.trimmed_array(json.dumps(rows))
    assert json.loads(short.split("  [+")[0]) == rows[:3] and short.endswith("[+3 similar items omitted]")


def test_the_pattern_of_foreign_verbs_runs_only_where_it_may_find_something(monkeypatch):
    tried = []

    class Counted:
        def search(self, text):
            tried.append(text)
            return whole.search(text)

        def match(self, text, at):
            tried.append(text)
            return whole.match(text, at)

    whole = language.PATTERN
    texts = [f(f"{a}{w}{b}") for w, _ in language._SPELLED for a, b in (("", ""), ("x ", " y"), ("é", "!"), ("-", "z")) for f in (str, str.upper, str.title)]
    texts += ["Iptal", "ıptal", "caﾄncelar", "uſar", "ta  bort", "ta bort", "\u0345 cancelar", "ΑΚΎΡΩΣΗ", "ακύρωσησ", "İptal"]
    monkeypatch.setattr(language, "PATTERN", Counted())
    for t in texts:
        m = whole.search(t)
        assert language.foreign_verb(t) == (language._VERB_OF.get(m.group().lower()) if m else None), t
    tried.clear()
    assert language.foreign_verb("You are an order agent. Preserve order IDs. " * 50) is None and language.foreign_verb("Größe und Länge sind süß") is None and not tried


def test_a_message_that_comes_again_is_decided_once(monkeypatch):
    D._held.cache_clear()
    calls = []
    monkeypatch.setattr(D, "decisive", lambda *a, f=D.decisive: calls.append(a) or f(*a))
    a, b = (D.decide("assistant", "I recommend ORDER-000123 at 5 %.", None, None, None) for _ in range(2))
    a["values"].append("x")
    assert len(calls) == 1 and "x" not in b["values"] and "x" not in D.decide("assistant", "I recommend ORDER-000123 at 5 %.", None, None, None)["values"]


def test_readable_and_tokens_as_their_patterns_say():
    for value in ("12", "5", "abc", "Ab_1", "aa"):
        for text in ("", "12", "a12", "312 12", "1212", "abc.", "xabc abc_", "ab_1", "aaa aa", "Éabc", "aaaa", "5²"):
            edge = "0-9" if value.isdigit() else "a-z0-9_"
            assert D.readable(value, text) == bool(re.search(rf"(?<![{edge}]){value.lower()}(?![{edge}])", text if value.isdigit() else text.lower()))
    for text in (None, "", " ", "a", " a", "a \n b\u2003", "\x1c x \x85", "\u200b a"):
        assert D.tokens(text) == len(re.findall(r"\S+|\s+", text or ""))


def test_flow_matrices_in_batches_are_as_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(f"t{t}", int(i), int(j), float(x)) for t in range(200) for i in range(t % 5 + 1) for j in range(10, 11 + t % 3) if (x := round(rng.random(), 3)) > 0.2]
    df = spark.createDataFrame(rows, "trace_id string, msg_idx int, decision int, flow double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        share, weight = {r.trace_id: r.explained for r in G.explained_variance(df).collect()}, {(r.trace_id, r.msg_idx): r.importance for r in G.spectral_importance(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for t in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == t]
        at, cols = (sorted({r[k] for r in mine}) for k in (1, 2))
        m = np.zeros((len(at), len(cols)))
        for _, i, j, x in mine:
            m[at.index(i), cols.index(j)] = x
        s = np.linalg.svd(m, compute_uv=False) ** 2
        assert abs(share.pop(t) - s[0] / s.sum()) < 1e-6
        v = (m**2).sum(1)
        want |= {(t, i): y for i, y in zip(at, v / v.max())}
    assert not share and weight.keys() == want.keys() and all(abs(weight[k] - want[k]) < 1e-9 for k in want)


def test_explained_variance_reads_all_decisions(spark):
    got = Q.queries()["explained_variance"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(0.5 < r.explained < 1 for r in got)  # two columns, which one alone doesn't explain


def test_surprisal_shuffles_messages_and_no_words(spark):
    m = spark.createDataFrame([("t", 0, "user", "a a B", None, None), ("t", 1, "tool", None, None, None), ("t", 2, "user", "A c c", None, None), ("u", 0, "user", "x", None, None), ("u", 0, "user", "y x", None, None)], C.MESSAGE)
    got = L.surprisal(m)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "explode" not in plan
    assert {(r.trace_id, r.msg_idx): r.bits for r in got.collect()} == {("t", 0): round(-math.log2(1 / 6), 6), ("t", 2): round(-math.log2(2 / 6), 6), ("u", 0): round(-math.log2(1 / 3), 6)}
