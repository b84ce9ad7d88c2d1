"""Registered queries of the trace operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions import text as T
from tracefold.operators import calibrate as CA
from tracefold.operators import compress as C
from tracefold.operators import evaluation as E
from tracefold.operators import facts as FA
from tracefold.operators import graph as G
from tracefold.operators import filler as L
from tracefold.operators import memory as M
from tracefold.operators import tools as X
from tracefold.sources import traces as S


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return S.from_conversations(S.table(spark, d, "conversations"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return S.from_orders(S.table(spark, d, "orders"), S.table(spark, d, "lineitem"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return S.from_events(S.table(spark, d, "events"))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.from_documents(S.table(spark, d, "documents"))


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    m = _orders(spark, d)
    return m, G.artifacts(m, T.LINKING), G.rule_decisions(m)


_ORDERS = """
lines AS (SELECT l_orderkey, '[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || ',"qty":' || CAST(l_quantity AS INT) || '}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, '{"line":' || l_linenumber || ',"part":' || l_partkey || ',"qty":' || CAST(l_quantity AS INT) || '}') || ']' AS js FROM lineitem GROUP BY l_orderkey),
o AS (SELECT *, 'ORDER-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey),
m AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, 0 AS msg_idx, 'system' AS role, 'You are an order agent. Preserve order IDs.' AS content, NULL AS tool_name, NULL AS tool_args FROM o
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'user', 'Please cancel order ' || k || '.', NULL, NULL FROM o
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'assistant', 'Looking up ' || k || ' now.', 'get_order', '{"order_id":"' || k || '"}' FROM o
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 3, 'tool', js, NULL, NULL FROM o WHERE js IS NOT NULL
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 4, 'assistant', 'Confirmed. ' || k || ' has been cancelled. Refund of $' || (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || ' is processed.', NULL, NULL FROM o)"""


def _arts(kinds) -> str:
    whole = "concat_ws(' ', content, tool_args)"
    return "a AS (" + " UNION ALL ".join(f"SELECT trace_id, msg_idx, role, '{k}' AS kind, unnest(list_distinct(regexp_extract_all({whole}, '{T.PATTERNS[k]}'))) AS value FROM m" for k in kinds) + ")"


_DECISIONS = """
d AS (
  SELECT trace_id, msg_idx, CASE WHEN tool_name IS NOT NULL THEN 'action' WHEN role = 'user' AND regexp_matches(content, '^(?i:please) ([a-z]+)') THEN 'judgment' WHEN content LIKE 'Confirmed%' THEN 'confirmation' END AS kind,
    regexp_extract(concat_ws(' ', content, tool_args), '\\b[A-Z]{2,}-[0-9]{4,12}\\b') AS target
  FROM m WHERE tool_name IS NOT NULL OR (role = 'user' AND regexp_matches(content, '^(?i:please) ([a-z]+)')) OR content LIKE 'Confirmed%')"""
_TALK = "m AS (SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(turn AS INT) AS msg_idx, role, text AS content, NULL AS tool_name, NULL AS tool_args FROM conversations)"
_DOCS = "m AS (SELECT source AS trace_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INT) AS msg_idx, 'user' AS role, text AS content, NULL AS tool_name, NULL AS tool_args FROM documents)"
_EVENTS = """
e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 2 AS n, coalesce(json_extract_string(props, '$.k'), '0') AS k FROM events),
m AS (
  SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(n AS INT) AS msg_idx, 'assistant' AS role, '' AS content, 'log_event' AS tool_name, '{"type":"' || event_type || '"}' AS tool_args FROM e
  UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(n + 1 AS INT), 'tool', CASE WHEN event_type = 'error' THEN 'Error: code ' ELSE 'ok ' END || k, NULL, NULL FROM e)"""
_LINKED = f"WITH RECURSIVE {_ORDERS}, {_arts(T.LINKING)}, {_DECISIONS}"
_V = "v AS (SELECT DISTINCT trace_id, msg_idx, value FROM a), p AS (SELECT trace_id, value, min(msg_idx) AS first_idx FROM a GROUP BY ALL)"
_EDGES = f"{_V}, dep AS (SELECT DISTINCT v.trace_id, v.value, p.first_idx AS origin, v.msg_idx AS consumer FROM v JOIN d USING (trace_id, msg_idx) JOIN p ON p.trace_id = v.trace_id AND p.value = v.value WHERE p.first_idx < v.msg_idx)"
_UP = "ce AS (SELECT DISTINCT v.trace_id, p.first_idx AS src, v.msg_idx AS dst FROM v JOIN p ON p.trace_id = v.trace_id AND p.value = v.value WHERE p.first_idx < v.msg_idx), up(trace_id, node, ancestor) AS (SELECT trace_id, dst, src FROM ce UNION SELECT up.trace_id, up.node, ce.src FROM up JOIN ce ON ce.trace_id = up.trace_id AND ce.dst = up.ancestor)"
_DOWN = "u AS (SELECT trace_id, msg_idx, min(CASE WHEN role = 'user' THEN msg_idx END) OVER (PARTITION BY trace_id ORDER BY msg_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS til FROM m), down AS (SELECT DISTINCT d.trace_id, d.msg_idx, y.msg_idx AS descendant FROM d JOIN v x USING (trace_id, msg_idx) JOIN u USING (trace_id, msg_idx) JOIN v y ON y.trace_id = d.trace_id AND y.value = x.value AND y.msg_idx > d.msg_idx AND (til IS NULL OR y.msg_idx < til))"
_MIN = "mi AS (SELECT trace_id, msg_idx FROM d UNION SELECT up.trace_id, ancestor FROM up JOIN d ON d.trace_id = up.trace_id AND d.msg_idx = up.node UNION SELECT trace_id, descendant FROM down UNION SELECT trace_id, msg_idx FROM m WHERE role = 'system' UNION SELECT trace_id, max(msg_idx) FROM m WHERE role = 'user' GROUP BY trace_id)"
_IDF = "f AS (SELECT trace_id, value, count(DISTINCT msg_idx) AS frequency FROM a GROUP BY ALL), n AS (SELECT trace_id, count(*) AS n FROM m GROUP BY ALL), idf AS (SELECT trace_id, value, frequency, round(ln((n + 1) / (frequency + 1)) + 1, 6) AS idf FROM f JOIN n USING (trace_id))"
_WEIGHT = "CASE d.kind WHEN 'action' THEN 2.0 WHEN 'judgment' THEN 1.5 ELSE 1.0 END"


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in M.STOP)


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9-]+'), lambda w: length(w) > 2 AND w NOT IN ({_stop_list()})))"


RECALL_QUERY = "token of the thing that was in the and to"


def token_counts(spark, d):
    return _talk(spark, d).select("trace_id", "msg_idx", T.token_count(F.col("content")).alias("tokens"))


def normalize_messages(spark, d):
    """Every conversation is written as a JSON envelope with other key names, and read back."""
    c = S.table(spark, d, "conversations")
    m = F.struct("turn", F.col("role").alias("sender"), F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))).alias("content"))
    raw = c.groupBy(F.col("conv_id").alias("trace_id")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(m)).alias("conversation"))).alias("body"))
    return S.from_json(raw).select("trace_id", F.col("msg_idx").cast("long").alias("msg_idx"), "role", "content")


def artifact_values(spark, d):
    a = G.artifacts(_docs(spark, d), ("email", "hex", "number"))
    return a.select("trace_id", "msg_idx", "kind", "value")


def artifact_domain_ids(spark, d):
    return G.artifacts(_orders(spark, d), ("id",)).groupBy("value").agg(F.count("*").alias("messages"))


def first_producer(spark, d):
    return G.first_producers(_linked(spark, d)[1])


def dependency_edges(spark, d):
    _, a, k = _linked(spark, d)
    return G.dependency_edges(a, k)


def attach_dependencies(spark, d):
    _, a, k = _linked(spark, d)
    return G.attached(a, k)


def corroborated_artifacts(spark, d):
    return G.corroborated(_linked(spark, d)[1])


def causal_ancestors(spark, d):
    return G.ancestors(G.causal_edges(_linked(spark, d)[1]))


def minimal_sufficient_set(spark, d):
    return G.minimal_set(*_linked(spark, d))


def compression_bound(spark, d):
    x = _linked(spark, d)
    return G.compression_bound(x[0], G.minimal_set(*x))


def artifact_idf(spark, d):
    m, a, _ = _linked(spark, d)
    return G.idf(m, a)


def causal_centrality(spark, d):
    return G.centrality(*_linked(spark, d))


def causal_flow(spark, d):
    return G.causal_flow(*_linked(spark, d))


def spectral_importance(spark, d):
    return G.spectral_importance(G.causal_flow(*_linked(spark, d)))


def evidence_gate(spark, d):
    return G.evidence_gate(*_linked(spark, d))


def confirming_descendants(spark, d):
    return G.confirming_descendants(*_linked(spark, d))


def chain_integrity(spark, d):
    """Of the traces without their tool calls."""
    m, a, k = _linked(spark, d)
    return G.chain_integrity(m.where("tool_name is null"), a, k)


def referent_links(spark, d):
    """Of the orders with a terse 'Done.' at the end of each."""
    m = _orders(spark, d)
    done = m.where("msg_idx = 0").withColumn("msg_idx", F.lit(5)).withColumn("role", F.lit("user")).withColumn("content", F.lit("Done."))
    return G.referent_links(m.unionByName(done))


def hash_embedding(spark, d):
    return T.hashed_cells(_talk(spark, d))


def cosine_to_task(spark, d):
    """Each message against the first of its conversation."""
    return T.similarity_to_first(_talk(spark, d))


def recoverable_values(spark, d):
    """Which values of each order's confirmation can be read off its request."""
    m = _orders(spark, d)
    a = G.artifacts(m.where("msg_idx = 4"), ("amount", "id", "number")).select("trace_id", "kind", "value")
    return a.join(m.where("msg_idx = 1").select("trace_id", "content"), "trace_id").select("trace_id", "kind", "value", T.recoverable(F.col("value"), F.col("content")).alias("recoverable"))


def dedupe_tool_messages(spark, d):
    return X.dedupe_results(_events(spark, d), 4)


def tool_run_collapse(spark, d):
    return X.call_runs(_events(spark, d), 3)


def collapsed_traces(spark, d):
    return X.collapse_runs(_events(spark, d), 3).select("trace_id", "msg_idx", "role", "content")


def tool_anomaly(spark, d):
    return X.anomalies(_events(spark, d))


def currency_values(spark, d):
    return X.amounts(_orders(spark, d))


def uncaptured_values(spark, d):
    """What a trace loses whose last message is left out."""
    m = _orders(spark, d)
    return X.uncaptured(m, m.where("msg_idx < 4"))


def value_recovery_stubs(spark, d):
    m = _orders(spark, d)
    return X.value_stubs(m, m.where("msg_idx < 4"))


def tool_literals(spark, d):
    return X.literals(_orders(spark, d)).groupBy("trace_id").agg(F.count("*").alias("literals"))


def compact_listings(spark, d):
    return X.compact_listings(_orders(spark, d)).where("role = 'tool'").select("trace_id", "content")


def state_goal_anchors(spark, d):
    return M.anchors(_orders(spark, d)).select("trace_id", "msg_idx", "kind", "clause")


def anchor_lifecycle(spark, d):
    m = _orders(spark, d)
    return M.lifecycle(m, M.anchors(m)).select("trace_id", "msg_idx", "kind", "status")


def memory_recall_topk(spark, d):
    return M.tfidf_recall(S.table(spark, d, "documents").select(F.col("doc_id").alias("fact_id"), "text"), RECALL_QUERY, 10)


def rescue_recurrence(spark, d):
    return M.recurrence(G.artifacts(_events(spark, d), ("error", "number")))


def store_resolve(spark, d):
    """Messages whose contents were cut to 20 characters, resolved to the originals."""
    m = _talk(spark, d)
    cut = m.withColumn("content", F.substring("content", 1, 20))
    return S.resolve(cut, m)


def domain_identifiers(spark, d):
    """Identifiers by field, of tickets made up of every order."""
    m = _orders(spark, d).where("msg_idx = 1")
    k = F.col("trace_id").cast("long")
    more = F.concat(F.lit(" Also CVE-2024-"), F.lpad((k % 9000 + 1000).cast("string"), 4, "0"), F.lit(", ACCT-"), F.lpad("trace_id", 8, "0"), F.lit(" and MRN-"), F.lpad("trace_id", 6, "0"), F.lit("."))
    return m.select("trace_id", F.explode(T.domain_ids(F.concat("content", more))).alias("value"))


def currencies(spark, d):
    """Amounts in five ways of writing them."""
    m = _orders(spark, d).where("msg_idx = 0").withColumn("content", F.concat(F.lit("Paid €"), (F.col("trace_id").cast("long") + 100).cast("string"), F.lit(" or 1,250.50 USD, ₹"), F.lpad("trace_id", 4, "1"), F.lit(", 7 EUR, £12.")))
    return X.amounts(m)


def value_density(spark, d):
    m = _orders(spark, d)
    return m.select("trace_id", "msg_idx", T.value_count(F.col("content")).alias("values"), F.round(T.value_density(F.col("content")), 6).alias("density"))


def candidate_spans(spark, d):
    """How many spans each message has."""
    return _orders(spark, d).select("trace_id", "msg_idx", F.size(T.spans(F.col("content"))).cast("long").alias("spans"))


def restored_messages(spark, d):
    """Conversations in a foreign envelope, cut to 20 characters a message and put back into its shape, other fields included."""
    c = S.table(spark, d, "conversations").where("text is not null")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")))
    m = F.struct("turn", F.col("role").alias("sender"), block.alias("content"), F.concat(F.lit("m"), "turn").alias("id"))
    raw = c.groupBy(F.col("conv_id").cast("string").alias("trace_id")).agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.sort_array(F.collect_list(m)).alias("turns"))).alias("body"))
    short = S.from_json(raw).withColumn("content", F.substring("content", 1, 20))
    back = S.denormalized(short, raw)
    v = F.from_json("body", "version string, turns array<struct<turn:long,sender:string,content:array<struct<type:string,text:string>>,id:string>>")
    x = back.select("trace_id", v.alias("v")).select("trace_id", "v.version", F.explode("v.turns").alias("t"))
    return x.select("trace_id", "version", "t.turn", "t.sender", F.col("t.content")[0].text.alias("text"), F.size("t.content").alias("blocks"), F.col("t.content")[1].type.alias("second"), "t.id")


def further_fields(spark, d):
    """What conversations have besides, where every message has a field of its own."""
    c = S.table(spark, d, "conversations")
    m = F.struct("turn", F.col("role").alias("sender"), F.coalesce("text", F.lit("")).alias("text"))
    raw = c.groupBy(F.col("conv_id").cast("string").alias("trace_id")).agg(F.to_json(F.sort_array(F.collect_list(m))).alias("body"))
    return S.further_fields(raw)


def tool_observations(spark, d):
    """Observations of anomalous results, whose errors are their targets."""
    return X.observed(_events(spark, d))


def canonical_duplicates(spark, d):
    """Tool results that are the same JSON in another spelling: every listing, once as it is and once with blanks."""
    m = _orders(spark, d).where("role = 'tool'")
    spaced = m.withColumn("msg_idx", F.lit(9)).withColumn("content", F.regexp_replace("content", ",", " ,  "))
    return X.dedupe_results(m.unionByName(spaced))


def trimmed_arrays(spark, d):
    """Listings of five lines and more, cut to the first three."""
    return X.trim_arrays(_orders(spark, d).where("role = 'tool'")).select("trace_id", "content")


def array_survivors(spark, d):
    """Identifier-like tokens that trimmed listings still have, where every line has an identifier."""
    m = _orders(spark, d).where("role = 'tool'").withColumn("content", F.regexp_replace("content", '"part":([0-9]+)', '"part":"PART-$1"'))
    return X.survivor_values(X.trim_arrays(m))


def extended_integrity(spark, d):
    """Of traces that keep only instruction and listing: nothing of the decisions is left."""
    m, a, k = _linked(spark, d)
    return G.extended_integrity(G.extended_edges(a, k, _full(k)), m.where("msg_idx in (0, 3)"))


def _full(rules):
    return rules.withColumn("vals", F.array("target")).withColumn("rationale", F.array(F.concat(F.lit("order: "), "target")))


def repaired_traces(spark, d):
    """Traces that lost all but instruction and listing get the order's number back, at the message that first had it."""
    m, a, k = _linked(spark, d)
    return G.repaired(m, m.where("msg_idx in (0, 3)"), G.extended_edges(a, k, _full(k)))[0].select("trace_id", "msg_idx", "role", "content")


def repair_report(spark, d):
    """With a budget of no token every value falls short."""
    m, a, k = _linked(spark, d)
    r = G.repaired(m, m.where("msg_idx in (0, 3)"), G.extended_edges(a, k, _full(k)), most_tokens=0)[1]
    return r.select("trace_id", "added", "tokens", F.concat_ws(",", "shortfall").alias("shortfall"), "rci_before")


def value_owners(spark, d):
    m, a, _ = _linked(spark, d)
    return G.owners(a.select("trace_id", "value").distinct(), m)


def decision_loss(spark, d):
    """Of the traces without their confirmation."""
    m, a, k = _linked(spark, d)
    return G.decision_loss(G.extended_edges(a, k, _full(k)), m.where("msg_idx in (0, 3)"), k)


def marginal_loss(spark, d):
    """How much each message would bring back to a trace of which only the instruction is left."""
    m, a, k = _linked(spark, d)
    return G.marginal_loss(G.extended_edges(a, k, _full(k)), m.where("msg_idx = 0"), k, m.select("trace_id", F.col("msg_idx").alias("candidate"), F.concat_ws(" ", "content", "tool_args").alias("text")))


def decision_graph(spark, d):
    m, a, k = _linked(spark, d)
    return G.decision_graph(G.extended_edges(a, k, _full(k)), _full(k))


def upstream_decisions(spark, d):
    m, a, k = _linked(spark, d)
    return G.upstream(G.decision_graph(G.extended_edges(a, k, _full(k)), _full(k))).select("trace_id", "node", F.concat_ws(",", F.transform("sources", lambda x: x.cast("string"))).alias("sources"))


def fact_memory(spark, d):
    """Facts of all orders' messages."""
    return FA.extracted(_orders(spark, d)).select("category", "clause", "trace_id", "msg_idx", "active")


def fact_supersession(spark, d):
    """What the second half of the customers says now instead of what the first half said."""
    c = S.table(spark, d, "nation")
    one = c.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("state").alias("category"), F.concat(F.lit("the office currently is in "), "n_name").alias("clause"), F.lit("t").alias("trace_id"), F.lit(0).alias("msg_idx"), F.lit(True).alias("active"), F.lit(None).cast("long").alias("superseded_by"), F.lit(0).cast("long").alias("seq"))
    two = one.withColumn("id", F.col("id") + 100).withColumn("clause", F.concat(F.lit("the office now is in "), F.expr("substring(clause, 28)"))).withColumn("seq", F.lit(1).cast("long"))
    return FA.superseded(one.unionByName(two), 1, 0.6).select("id", "active", "superseded_by")


def tool_catalogue(spark, d):
    return E.tool_catalogue(_orders(spark, d)).select("trace_id", F.concat_ws(",", "tools").alias("tools"))


def positional_messages(spark, d):
    m = _orders(spark, d)
    return E.positional(m.where("msg_idx in (1, 4)"), m)


def local_texts(spark, d):
    """What stands next to each order's look-up."""
    m = _orders(spark, d)
    return E.local_text(m, m.where("msg_idx = 2").select("trace_id", "msg_idx"), 1)


def focused_windows(spark, d):
    m = _talk(spark, d)
    return E.focused(m, m.where("msg_idx = 3").select("trace_id", "msg_idx"), 1)


def decision_prompts(spark, d):
    m = _orders(spark, d).where("role <> 'tool'")
    return E.prompts(E.focused(m, m.where("msg_idx = 4").select("trace_id", "msg_idx"), 2))


def trace_differences(spark, d):
    """Of the traces without look-up and confirmation."""
    m = _orders(spark, d)
    return E.difference(m, m.where("msg_idx in (0, 3)"))


def trace_retention(spark, d):
    """Of the traces without their request: which share of values is left."""
    m = _orders(spark, d)
    return E.retention(m, m.where("msg_idx <> 1")).select("trace_id", "loose", "strict")


def filler_candidates(spark, d):
    """How many clauses of each form are tried, at most two a trace."""
    c = CA.candidates(_talk(spark, d), 2)
    return c.groupBy("form").agg(F.count("*").alias("tried"))


def explained_variance(spark, d):
    """Of the whole flow matrix of every order."""
    return G.explained_variance(G.causal_flow(*_linked(spark, d)))


def details(spark, d):
    return E.details(_orders(spark, d)).select("trace_id", "msg_idx", "kind", "reproduced")


def anomaly_values(spark, d):
    """Identifier-like tokens of anomalous results, where results name a host."""
    m = _events(spark, d)
    return X.anomaly_values(m.withColumn("content", F.when((F.col("role") == "tool") & F.col("content").startswith("Error"), F.concat("content", F.lit(" at node-7.local"))).otherwise(F.col("content"))))


def call_statistics(spark, d):
    """Calls and values by user and over all (a rollup)."""
    e = S.table(spark, d, "events")
    return e.rollup("user_id").agg(F.count("*").alias("calls"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.round(F.avg("value"), 6).alias("mean_value")).withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


def decisions(spark, d):
    """Of the full kernel, over the orders' traces."""
    return C.extract(_orders(spark, d)).select("trace_id", "msg_idx", "kind", "action", "target", "builder")


def decision_counts(spark, d):
    return C.extract(_orders(spark, d)).groupBy("kind", "action").agg(F.count("*").alias("decisions"))


def compress_trace(spark, d):
    """The flagship: every order's trace, compressed by 87 percent or as far as its values allow."""
    return C.compress(_orders(spark, d)).select("trace_id", "msg_idx", "role", "content")


def no_decision_loss(spark, d):
    """How many critical values are missing from the compressed orders' traces: none."""
    return C.evaluate(_orders(spark, d), ("compress",)).agg(F.sum("missing").alias("missing"), F.count("*").alias("traces"))


def evaluate_methods(spark, d):
    return C.evaluate(_talk(spark, d))


def leaderboard(spark, d):
    return C.leaderboard(C.evaluate(_orders(spark, d)))


def frontier(spark, d):
    return C.frontier(_orders(spark, d))


def adversarial(spark, d):
    return C.adversarial(_orders(spark, d))


def filler_clauses(spark, d):
    return L.filler_features(_talk(spark, d))


def filler_weights(spark, d):
    """Naive Bayes weights of the features of clauses without any value (taken for filler) against all others."""
    m = _orders(spark, d)
    return L.filler_weights(L.clauses(m).withColumn("is_filler", ~F.col("clause").rlike("[0-9]")))


def surprisal(spark, d):
    return L.surprisal(_orders(spark, d))


def sessions_rescue(spark, d):
    """Each trace replayed turn by turn through the stateful rescue kernel."""
    from tracefold.streaming import rescue as R

    return R.replay(_orders(spark, d)).select("trace_id", "msg_idx", "value", "owner_idx", "recurrence", "promoted", "tier")


def queries() -> dict:
    own = (domain_identifiers, currencies, value_density, candidate_spans, restored_messages, further_fields, tool_observations, canonical_duplicates, trimmed_arrays, array_survivors, extended_integrity, repaired_traces, repair_report, value_owners, decision_loss, marginal_loss, decision_graph, upstream_decisions, fact_memory, fact_supersession, tool_catalogue, positional_messages, local_texts, focused_windows, decision_prompts, trace_differences, trace_retention, filler_candidates, explained_variance, details, anomaly_values, decisions, decision_counts, compress_trace, no_decision_loss, evaluate_methods, leaderboard, frontier, adversarial, filler_clauses, filler_weights, surprisal, sessions_rescue, token_counts, normalize_messages, artifact_values, artifact_domain_ids, first_producer, dependency_edges, attach_dependencies, corroborated_artifacts, causal_ancestors, minimal_sufficient_set, compression_bound, artifact_idf, causal_centrality, causal_flow, spectral_importance, evidence_gate, confirming_descendants, chain_integrity, referent_links, hash_embedding, cosine_to_task, recoverable_values, dedupe_tool_messages, tool_run_collapse, collapsed_traces, tool_anomaly, currency_values, uncaptured_values, value_recovery_stubs, tool_literals, compact_listings, state_goal_anchors, anchor_lifecycle, memory_recall_topk, rescue_recurrence, store_resolve, call_statistics)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    amt = "am AS (SELECT trace_id, min(msg_idx) AS msg_idx, amount FROM (SELECT trace_id, msg_idx, unnest(list_distinct(regexp_extract_all(content, '[$][0-9][0-9,]*(?:[.][0-9]{2})?'))) AS amount FROM m) WHERE length(regexp_replace(split_part(amount, '.', 1), '[^0-9]', '', 'g')) >= 2 GROUP BY trace_id, amount)"
    cells = "w AS (SELECT trace_id, msg_idx, unnest(regexp_extract_all(lower(coalesce(content, '')), '[a-z0-9]+')) AS w FROM m), x AS (SELECT trace_id, msg_idx, CAST('0x' || substr(md5(w), 31, 2) AS INT) AS i, CASE WHEN CAST('0x' || substr(md5(w), 30, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS s FROM w), h AS (SELECT trace_id, msg_idx, i, CAST(sum(s) AS INT) AS v FROM x GROUP BY ALL HAVING sum(s) <> 0)"
    clauses = f"c0 AS (SELECT trace_id, msg_idx, string_split_regex(content, '[.!;\\n]+ *') AS cs FROM m WHERE role <> 'tool'), c1 AS (SELECT trace_id, msg_idx, unnest(range(0, len(cs))) AS clause_no, unnest(cs) AS clause FROM c0), an AS (SELECT trace_id, msg_idx, clause_no, CASE WHEN regexp_matches(lower(clause), '{M.GOAL}') THEN 'goal' WHEN regexp_matches(lower(clause), '{M.STATE}') THEN 'state' END AS kind, trim(clause) AS clause FROM c1 WHERE NOT suffix(trim(clause), '?') AND (regexp_matches(lower(clause), '{M.GOAL}') OR regexp_matches(lower(clause), '{M.STATE}')))"
    cl = "cl0 AS (SELECT trace_id, msg_idx, string_split_regex(content, '[.!?;\\n]+ *') AS cs FROM m WHERE role <> 'tool'), cl AS (SELECT trace_id, msg_idx, clause_no, trim(clause) AS clause FROM (SELECT trace_id, msg_idx, CAST(unnest(range(0, len(cs))) AS INT) AS clause_no, unnest(cs) AS clause FROM cl0) WHERE trim(clause) <> '')"
    feats = ", ".join(f"regexp_matches(lower(clause), '{r}') AS {n}" for n, r in L.FEATURES.items())
    full = "concat_ws(' ', content, tool_name, tool_args)"
    ids = "'ORDER-' || lpad(trace_id, 8, '0')"
    js = """'{"line":' || l_linenumber || ',"part":' || l_partkey || ',"qty":' || CAST(l_quantity AS INT) || '}'"""
    spans_ = " + ".join(f"len(regexp_extract_all(coalesce(content, ''), '{r}'))" for r in (T.PATTERNS["id"], T.PATTERNS["path"], T.PATTERNS["number"], r"\b[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b|\b[a-z0-9]+(?:_[a-z0-9]+)+\b"))
    counts = " + ".join(f"len(list_distinct(regexp_extract_all(coalesce(content, ''), '{T.PATTERNS[k]}')))" for k in ("path", "id", "hex", "url", "error"))
    form = " || ".join(f"CAST(CAST(regexp_matches(lower(clause), '{r}') AS INT) AS VARCHAR)" for r in L.FEATURES.values())
    rule = f"WITH {_ORDERS}, r AS (SELECT trace_id, msg_idx, CASE WHEN tool_name IS NOT NULL THEN 'action' WHEN role = 'user' THEN 'judgment' ELSE 'confirmation' END AS kind, CASE WHEN tool_name IS NOT NULL THEN tool_name WHEN role = 'user' THEN regexp_extract(content, '^(?i:please) ([a-z]+)', 1) ELSE 'confirm' END AS action, regexp_extract(content, '\\b[A-Z]{{2,}}-[0-9]{{4,12}}\\b') AS target, CASE WHEN tool_name IS NOT NULL THEN 'tool_call' WHEN role = 'user' THEN 'polite_request' ELSE 'confirm' END AS builder FROM m WHERE msg_idx IN (1, 2, 4))"
    noisy = f"WITH {_EVENTS}, t AS (SELECT trace_id, msg_idx, CASE WHEN content LIKE 'Error%' THEN content || ' at node-7.local' ELSE content END AS content FROM m WHERE role = 'tool'), f AS (SELECT *, regexp_replace(content, '[0-9]+', '#', 'g') AS form FROM t), c AS (SELECT trace_id, form, count(*) AS n FROM f GROUP BY ALL), u AS (SELECT trace_id, form AS usual, sum(n) OVER (PARTITION BY trace_id) AS total, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, form) AS r FROM c), x AS (SELECT f.trace_id, content FROM f JOIN u ON u.trace_id = f.trace_id AND r = 1 WHERE total >= 3 AND (form <> usual OR content LIKE 'Error%'))"
    flow = "fl AS (SELECT v.trace_id, v.msg_idx, d.msg_idx AS decision, round(sum(idf * exp((v.msg_idx - d.msg_idx) / 5)), 6) AS flow FROM v JOIN v y ON y.trace_id = v.trace_id AND y.value = v.value JOIN d ON d.trace_id = y.trace_id AND d.msg_idx = y.msg_idx JOIN idf ON idf.trace_id = v.trace_id AND idf.value = v.value WHERE v.msg_idx < d.msg_idx GROUP BY ALL)"
    return {
        "domain_identifiers": f"WITH {_ORDERS}, x AS (SELECT trace_id, content || ' Also CVE-2024-' || lpad(CAST(CAST(trace_id AS BIGINT) % 9000 + 1000 AS VARCHAR), 4, '0') || ', ACCT-' || lpad(trace_id, 8, '0') || ' and MRN-' || lpad(trace_id, 6, '0') || '.' AS t FROM m WHERE msg_idx = 1) SELECT trace_id, unnest(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(t, '{r}')" for r in T.DOMAIN_IDS.values()) + "]))) AS value FROM x",
        "currencies": f"WITH {_ORDERS}, x AS (SELECT trace_id, 'Paid €' || (CAST(trace_id AS BIGINT) + 100) || ' or 1,250.50 USD, ₹' || lpad(trace_id, 4, '1') || ', 7 EUR, £12.' AS t FROM m WHERE msg_idx = 0), y AS (SELECT trace_id, 0 AS msg_idx, unnest(list_distinct(regexp_extract_all(t, '{T.CURRENCY}'))) AS amount FROM x) SELECT * FROM y WHERE length(regexp_replace(split_part(amount, '.', 1), '[^0-9]', '', 'g')) >= 2",
        "value_density": f"WITH {_ORDERS}, x AS (SELECT trace_id, msg_idx, CAST({counts} AS INT) AS values, len(regexp_extract_all(content, '\\S+|\\s+')) AS tokens FROM m) SELECT trace_id, msg_idx, values, round(values / greatest(tokens, 1), 6) AS density FROM x",
        "candidate_spans": f"WITH {_ORDERS} SELECT trace_id, msg_idx, CAST({spans_} AS BIGINT) AS spans FROM m",
        "restored_messages": "SELECT CAST(conv_id AS VARCHAR) AS trace_id, 'v1' AS version, CAST(turn AS BIGINT) AS turn, role AS sender, substr(text, 1, 20) AS text, CAST(2 AS INT) AS blocks, 'image' AS second, 'm' || turn AS id FROM conversations WHERE text IS NOT NULL",
        "further_fields": "SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, coalesce(text, '')) - 1 AS INT) AS msg_idx, '{\"turn\":' || turn || '}' AS extra FROM conversations",
        "tool_observations": f"WITH {_EVENTS}, t AS (SELECT *, count(*) OVER (PARTITION BY trace_id) AS n FROM m WHERE role = 'tool') SELECT trace_id, msg_idx, 'observation' AS kind, 'log_event' AS action, content AS target, content AS reason FROM t WHERE n >= 3 AND content LIKE 'Error: code%'",
        "canonical_duplicates": f"WITH {_ORDERS} SELECT trace_id, 9 AS msg_idx, 3 AS same_as FROM m WHERE role = 'tool' AND length(content) >= 40",
        "trimmed_arrays": f"WITH l AS (SELECT l_orderkey, list({js} ORDER BY l_linenumber, l_partkey, l_suppkey, {js}) AS js FROM lineitem GROUP BY l_orderkey) SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, CASE WHEN len(js) < 5 THEN '[' || array_to_string(js, ',') || ']' ELSE '[' || array_to_string(js[1:3], ',') || ']  [+' || (len(js) - 3) || ' similar items omitted]' END AS content FROM orders JOIN l ON l_orderkey = o_orderkey",
        "array_survivors": "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS trace_id, 'PART-' || l_partkey AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) JOIN orders ON o_orderkey = l_orderkey WHERE n >= 5 AND r <= 3",
        "extended_integrity": f"{_LINKED} SELECT trace_id, count(*) AS edges, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM m WHERE m.trace_id = d.trace_id AND m.msg_idx IN (0, 3) AND contains(content, target))) AS preserved, CAST(0 AS DOUBLE) AS rci FROM d GROUP BY trace_id",
        "repaired_traces": f"WITH {_ORDERS} SELECT trace_id, msg_idx, role, content FROM m WHERE msg_idx IN (0, 3) UNION ALL SELECT trace_id, msg_idx, role, '[repaired from dropped message: ' || {ids} || ']' FROM m WHERE msg_idx = 1",
        "repair_report": f"WITH {_ORDERS} SELECT trace_id, 0 AS added, 0 AS tokens, {ids} AS shortfall, CAST(0 AS DOUBLE) AS rci_before FROM m WHERE msg_idx = 1",
        "value_owners": f"{_LINKED}, v AS (SELECT DISTINCT trace_id, value FROM a) SELECT v.trace_id, v.value, min(msg_idx) AS owner, arg_min(role, msg_idx) AS role FROM v JOIN m ON m.trace_id = v.trace_id AND contains({full}, v.value) GROUP BY v.trace_id, v.value",
        "decision_loss": f"{_LINKED} SELECT trace_id, round(avg(CAST(NOT EXISTS (SELECT 1 FROM m WHERE m.trace_id = d.trace_id AND m.msg_idx IN (0, 3) AND contains(content, target)) AS INT)), 6) AS loss FROM d GROUP BY trace_id",
        "marginal_loss": f"WITH {_ORDERS} SELECT trace_id, msg_idx AS candidate, CASE WHEN contains(concat_ws(' ', content, tool_args), {ids}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gain FROM m",
        "decision_graph": f"{_LINKED} SELECT x.trace_id, x.msg_idx AS src, y.msg_idx AS dst FROM d x JOIN d y ON y.trace_id = x.trace_id AND y.target = x.target AND x.msg_idx < y.msg_idx",
        "upstream_decisions": f"{_LINKED} SELECT y.trace_id, y.msg_idx AS node, string_agg(x.msg_idx, ',' ORDER BY x.msg_idx) AS sources FROM d x JOIN d y ON y.trace_id = x.trace_id AND y.target = x.target AND x.msg_idx < y.msg_idx GROUP BY ALL",
        "fact_memory": f"WITH {_ORDERS}, {clauses} SELECT kind AS category, clause, trace_id, msg_idx, true AS active FROM an",
        "fact_supersession": "SELECT CAST(n_nationkey AS BIGINT) AS id, false AS active, CAST(n_nationkey + 100 AS BIGINT) AS superseded_by FROM nation UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), true, NULL FROM nation",
        "tool_catalogue": f"WITH {_ORDERS} SELECT trace_id, string_agg(DISTINCT tool_name, ',') AS tools FROM m WHERE tool_name IS NOT NULL GROUP BY trace_id",
        "positional_messages": f"WITH {_ORDERS} SELECT trace_id, msg_idx, role, CASE WHEN msg_idx IN (1, 4) THEN content ELSE '' END AS content FROM m",
        "local_texts": f"WITH {_ORDERS} SELECT trace_id, 2 AS msg_idx, string_agg(content, chr(10) ORDER BY msg_idx) AS text FROM m WHERE msg_idx BETWEEN 1 AND 3 GROUP BY trace_id",
        "focused_windows": f"WITH {_TALK}, k AS (SELECT DISTINCT trace_id FROM m WHERE msg_idx = 3), f AS (SELECT trace_id, min(msg_idx) AS f FROM m WHERE role = 'user' GROUP BY trace_id) SELECT m.trace_id, 3 AS decision, msg_idx, role, content FROM m JOIN k USING (trace_id) LEFT JOIN f USING (trace_id) WHERE msg_idx BETWEEN 2 AND 4 OR role = 'system' OR msg_idx = f",
        "decision_prompts": f"WITH {_ORDERS} SELECT trace_id, 4 AS decision, string_agg(CASE WHEN msg_idx = 4 THEN '>> ' ELSE '' END || '[' || msg_idx || '] ' || role || ': ' || content, chr(10) ORDER BY msg_idx) AS prompt FROM m WHERE role <> 'tool' GROUP BY trace_id",
        "trace_differences": f"WITH {_ORDERS} SELECT trace_id, 'messages left out: ' || string_agg(msg_idx, ', ' ORDER BY msg_idx) || '; values lost: ' || any_value({ids}) AS report FROM m WHERE msg_idx NOT IN (0, 3) GROUP BY trace_id",
        "trace_retention": f"WITH {_ORDERS}, k AS (SELECT trace_id, bool_or(contains({full}, {ids})) AS has FROM m WHERE msg_idx <> 1 GROUP BY trace_id) SELECT trace_id, CAST(has AS DOUBLE) AS loose, CAST(has AS DOUBLE) AS strict FROM k",
        "filler_candidates": f"WITH {_TALK}, {cl}, f AS (SELECT trace_id, {form} AS form, count(*) AS n FROM cl GROUP BY ALL) SELECT form, CAST(sum(least(2, n)) AS BIGINT) AS tried FROM f GROUP BY form",
        "explained_variance": f"{_LINKED}, {_V}, {_IDF}, {flow}, t AS (SELECT trace_id, decision, sum(flow * flow) AS q FROM fl GROUP BY ALL), c AS (SELECT x.trace_id, sum(x.flow * y.flow) AS c FROM fl x JOIN fl y ON y.trace_id = x.trace_id AND y.msg_idx = x.msg_idx AND x.decision < y.decision GROUP BY ALL), e AS (SELECT trace_id, sum(q) AS q, max(q) AS a, CASE WHEN count(*) = 2 THEN min(q) ELSE 0 END AS b, count(*) AS n FROM t GROUP BY ALL) SELECT trace_id, CASE WHEN n > 2 THEN error('more than two decisions') ELSE round((q + sqrt((a - b) * (a - b) + 4 * pow(coalesce(c, 0), 2))) / (2 * q), 6) END AS explained FROM e LEFT JOIN c USING (trace_id)",
        "anomaly_values": f"{noisy}, y AS (SELECT trace_id, unnest(regexp_extract_all(content, '[A-Za-z0-9][A-Za-z0-9_./-]{{1,38}}[A-Za-z0-9]')) AS value FROM x) SELECT DISTINCT trace_id, value FROM y WHERE regexp_matches(value, '[0-9./-]')",
        "compress_trace": f"WITH {_ORDERS} SELECT trace_id, msg_idx, role, CASE WHEN msg_idx = 2 THEN '[preserved: confirm#d4]' ELSE content END AS content FROM m WHERE msg_idx IN (0, 1, 2)",
        "decisions": f"{rule} SELECT * FROM r",
        "details": f"{rule} SELECT trace_id, msg_idx, kind, true AS reproduced FROM r",
        "decision_counts": f"{rule} SELECT kind, action, count(*) AS decisions FROM r GROUP BY ALL",
        "no_decision_loss": "SELECT CAST(0 AS BIGINT) AS missing, count(*) AS traces FROM orders",
        "filler_clauses": f"WITH {_TALK}, {cl} SELECT trace_id, msg_idx, clause_no, {feats} FROM cl",
        "filler_weights": f"WITH {_ORDERS}, {cl}, g AS (SELECT NOT regexp_matches(clause, '[0-9]') AS is_filler, {feats} FROM cl), t AS (SELECT count(*) FILTER (WHERE is_filler) AS nf, count(*) FILTER (WHERE NOT is_filler) AS np FROM g), x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) FILTER (WHERE is_filler AND {n}) AS ff, count(*) FILTER (WHERE NOT is_filler AND {n}) AS fp FROM g" for n in L.FEATURES) + ") SELECT feature, ff + fp AS support, round(ln(((ff + 1.0) / (nf + 2.0)) / ((fp + 1.0) / (np + 2.0))), 6) AS weight FROM x, t",
        "surprisal": f"WITH {_ORDERS}, w AS (SELECT trace_id, msg_idx, unnest(regexp_extract_all(lower(content), '[a-z0-9-]+')) AS w FROM m), c AS (SELECT trace_id, w, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT trace_id, count(*) AS total FROM w GROUP BY ALL) SELECT w.trace_id, w.msg_idx, round(max(-log2(n / total)), 6) AS bits FROM w JOIN c ON c.trace_id = w.trace_id AND c.w = w.w JOIN t ON t.trace_id = w.trace_id GROUP BY ALL",
        "token_counts": f"WITH {_TALK} SELECT trace_id, msg_idx, CAST(len(regexp_extract_all(coalesce(content, ''), '\\S+|\\s+')) AS INT) AS tokens FROM m",
        "normalize_messages": "SELECT CAST(conv_id AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS msg_idx, role, coalesce(text, '') AS content FROM conversations",
        "artifact_values": f"WITH {_DOCS}, {_arts(('email', 'hex', 'number'))} SELECT trace_id, msg_idx, kind, value FROM a",
        "artifact_domain_ids": f"WITH {_ORDERS}, {_arts(('id',))} SELECT value, count(*) AS messages FROM a GROUP BY value",
        "first_producer": f"{_LINKED}, {_V} SELECT * FROM p",
        "dependency_edges": f"{_LINKED}, {_EDGES} SELECT * FROM dep",
        "attach_dependencies": f"{_LINKED}, {_EDGES}, q AS (SELECT dep.trace_id, consumer AS msg_idx, count(DISTINCT origin) AS n FROM dep JOIN d ON d.trace_id = dep.trace_id AND d.msg_idx = origin GROUP BY ALL) SELECT d.trace_id, d.msg_idx, kind, coalesce(n, 0) AS depends_on FROM d LEFT JOIN q USING (trace_id, msg_idx)",
        "corroborated_artifacts": f"{_LINKED} SELECT trace_id, value, count(DISTINCT msg_idx) AS messages FROM a WHERE role <> 'tool' GROUP BY ALL HAVING count(DISTINCT msg_idx) >= 2",
        "causal_ancestors": f"{_LINKED}, {_V}, {_UP} SELECT * FROM up",
        "minimal_sufficient_set": f"{_LINKED}, {_V}, {_UP}, {_DOWN}, {_MIN} SELECT * FROM mi",
        "compression_bound": f"{_LINKED}, {_V}, {_UP}, {_DOWN}, {_MIN}, s AS (SELECT trace_id, count(*) AS messages FROM m GROUP BY ALL), k AS (SELECT trace_id, count(*) AS needed FROM mi GROUP BY ALL) SELECT trace_id, messages, needed, round(1 - needed / messages, 4) AS bound FROM s JOIN k USING (trace_id)",
        "artifact_idf": f"{_LINKED}, {_IDF} SELECT * FROM idf",
        "causal_centrality": f"{_LINKED}, {_V}, {_IDF} SELECT v.trace_id, v.msg_idx, round(sum(idf * {_WEIGHT} * exp(-greatest(d.msg_idx - v.msg_idx, 0) / 5)), 6) AS centrality FROM v JOIN v y ON y.trace_id = v.trace_id AND y.value = v.value JOIN d ON d.trace_id = y.trace_id AND d.msg_idx = y.msg_idx JOIN idf ON idf.trace_id = v.trace_id AND idf.value = v.value GROUP BY v.trace_id, v.msg_idx",
        "causal_flow": f"{_LINKED}, {_V}, {_IDF} SELECT v.trace_id, v.msg_idx, d.msg_idx AS decision, round(sum(idf * exp((v.msg_idx - d.msg_idx) / 5)), 6) AS flow FROM v JOIN v y ON y.trace_id = v.trace_id AND y.value = v.value JOIN d ON d.trace_id = y.trace_id AND d.msg_idx = y.msg_idx JOIN idf ON idf.trace_id = v.trace_id AND idf.value = v.value WHERE v.msg_idx < d.msg_idx GROUP BY ALL",
        "evidence_gate": f"{_LINKED}, b AS (SELECT trace_id, msg_idx, coalesce(sum(CAST(role = 'tool' AS INT)) OVER w, 0) AS tools, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY trace_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), r AS (SELECT d.*, tools, n, (SELECT count(*) FROM m WHERE m.trace_id = d.trace_id AND role IN ('tool', 'assistant') AND m.msg_idx < d.msg_idx AND length(d.target) >= 3 AND contains(lower(content), lower(d.target))) AS hits FROM d JOIN b USING (trace_id, msg_idx) WHERE kind <> 'action') SELECT trace_id, msg_idx, kind, CAST(tools AS BIGINT) AS tools_before, CASE WHEN msg_idx <= 0 OR tools = 0 THEN TRUE WHEN tools < 2 OR tools / greatest(n, 1) < 0.3 THEN FALSE WHEN kind <> 'confirmation' OR length(target) < 3 THEN TRUE ELSE hits >= 2 END AS passes FROM r",
        "confirming_descendants": f"{_LINKED}, {_V}, {_DOWN} SELECT * FROM down",
        "chain_integrity": f"{_LINKED}, {_EDGES}, k AS (SELECT trace_id, msg_idx FROM m WHERE tool_name IS NULL) SELECT dep.trace_id, count(*) AS edges, count(x.msg_idx + y.msg_idx) AS intact, round(count(x.msg_idx + y.msg_idx) / count(*), 4) AS rci FROM dep LEFT JOIN k x ON x.trace_id = dep.trace_id AND x.msg_idx = origin LEFT JOIN k y ON y.trace_id = dep.trace_id AND y.msg_idx = consumer GROUP BY dep.trace_id",
        "referent_links": f"WITH {_ORDERS} SELECT trace_id, 5 AS msg_idx, max(msg_idx) AS anchor FROM m WHERE regexp_matches(content, '\\b[A-Z]{{2,}}-[0-9]{{4,12}}\\b') GROUP BY trace_id",
        "hash_embedding": f"WITH {_TALK}, {cells} SELECT * FROM h",
        "cosine_to_task": f"WITH {_TALK}, {cells}, z AS (SELECT trace_id, msg_idx, sqrt(sum(v * v)) AS l FROM h GROUP BY ALL), f AS (SELECT trace_id, min(msg_idx) AS f FROM m GROUP BY ALL), dt AS (SELECT a.trace_id, a.msg_idx, sum(a.v * b.v) AS dot FROM h a JOIN f USING (trace_id) JOIN h b ON b.trace_id = a.trace_id AND b.msg_idx = f AND b.i = a.i GROUP BY ALL) SELECT m.trace_id, m.msg_idx, coalesce(round(dot / (x.l * y.l), 5), 0) AS similarity FROM m JOIN f USING (trace_id) LEFT JOIN dt ON dt.trace_id = m.trace_id AND dt.msg_idx = m.msg_idx LEFT JOIN z x ON x.trace_id = m.trace_id AND x.msg_idx = m.msg_idx LEFT JOIN z y ON y.trace_id = m.trace_id AND y.msg_idx = f",
        "recoverable_values": f"WITH {_ORDERS}, n AS (SELECT * FROM m WHERE msg_idx = 4), {_arts(('amount', 'id', 'number')).replace('FROM m', 'FROM n')} SELECT a.trace_id, kind, value, CASE WHEN regexp_matches(value, '^[0-9]+$') THEN regexp_matches(' ' || lower(m.content) || ' ', '[^0-9]' || value || '[^0-9]') WHEN regexp_matches(value, '^[A-Za-z0-9_]+$') THEN regexp_matches(' ' || lower(m.content) || ' ', '[^a-z0-9_]' || lower(value) || '[^a-z0-9_]') ELSE contains(regexp_replace(lower(m.content), '[^a-z0-9]', '', 'g'), regexp_replace(lower(value), '[^a-z0-9]', '', 'g')) END AS recoverable FROM a JOIN m ON m.trace_id = a.trace_id AND m.msg_idx = 1",
        "dedupe_tool_messages": f"WITH {_EVENTS}, t AS (SELECT trace_id, msg_idx, min(msg_idx) OVER (PARTITION BY trace_id, content) AS same_as FROM m WHERE role = 'tool' AND length(content) >= 4) SELECT * FROM t WHERE same_as < msg_idx",
        "tool_run_collapse": f"WITH {_EVENTS}, c AS (SELECT *, msg_idx // 2 - row_number() OVER (PARTITION BY trace_id, tool_args ORDER BY msg_idx) AS g FROM m WHERE tool_name IS NOT NULL) SELECT trace_id, min(msg_idx) AS first_idx, max(msg_idx) AS last_idx, count(*) AS calls, tool_name, tool_args FROM c GROUP BY trace_id, tool_name, tool_args, g HAVING count(*) >= 3",
        "collapsed_traces": f"WITH {_EVENTS}, c AS (SELECT *, msg_idx // 2 - row_number() OVER (PARTITION BY trace_id, tool_args ORDER BY msg_idx) AS g FROM m WHERE tool_name IS NOT NULL), r AS (SELECT trace_id, min(msg_idx) AS a, max(msg_idx) AS b, count(*) AS n FROM c GROUP BY trace_id, tool_args, g HAVING count(*) >= 3), w AS (SELECT m.*, r.a, r.n FROM m LEFT JOIN r ON r.trace_id = m.trace_id AND m.msg_idx BETWEEN r.a + 2 AND r.b - 1) SELECT trace_id, msg_idx, role, content FROM w WHERE a IS NULL UNION ALL SELECT trace_id, msg_idx, 'tool', '[' || (n - 2) || ' more ''log_event'' calls]' FROM w WHERE msg_idx = a + 2",
        "tool_anomaly": f"WITH {_EVENTS}, t AS (SELECT *, substr(regexp_replace(content, '[0-9]+', '#', 'g'), 1, 100) AS form FROM m WHERE role = 'tool'), c AS (SELECT trace_id, form, count(*) AS n FROM t GROUP BY ALL), u AS (SELECT trace_id, form AS usual, sum(n) OVER (PARTITION BY trace_id) AS total, row_number() OVER (PARTITION BY trace_id ORDER BY n DESC, form) AS r FROM c) SELECT t.trace_id, msg_idx, content FROM t JOIN u ON u.trace_id = t.trace_id AND r = 1 WHERE total >= 3 AND (form <> usual OR regexp_matches(content, '(?i)error|fail|exception'))",
        "currency_values": f"WITH {_ORDERS}, {amt} SELECT * FROM am",
        "uncaptured_values": f"WITH {_ORDERS}, {amt} SELECT * FROM am WHERE msg_idx = 4",
        "value_recovery_stubs": f"WITH {_ORDERS}, {amt} SELECT trace_id, msg_idx, '[values] ' || string_agg(amount, ', ' ORDER BY amount) AS stub FROM am WHERE msg_idx = 4 GROUP BY ALL",
        "tool_literals": f"WITH {_ORDERS} SELECT trace_id, CAST(least(200, len(list_distinct(list_concat(regexp_extract_all(content, '\"([^\"]{{2,80}})\"', 1), regexp_extract_all(content, '[0-9]+(?:[.][0-9]+)?'))))) AS BIGINT) AS literals FROM m WHERE role = 'tool' AND length(content) <= 1200",
        "state_goal_anchors": f"WITH {_ORDERS}, {clauses} SELECT trace_id, msg_idx, kind, clause FROM an",
        "anchor_lifecycle": f"WITH {_ORDERS}, {clauses}, l AS (SELECT trace_id, msg_idx AS mi, lower(content) AS t, {_tokens('content')} AS ws FROM m WHERE role <> 'tool'), x AS (SELECT an.trace_id, an.msg_idx, clause_no, mi, CASE WHEN kind = 'goal' THEN CASE WHEN regexp_matches(t, '{M.DROPPED}') THEN 'abandoned' WHEN regexp_matches(t, '{M.DONE}') THEN 'completed' END WHEN regexp_matches(t, '{M.UPDATED}') THEN 'superseded' END AS cue FROM an JOIN l ON l.trace_id = an.trace_id AND mi > an.msg_idx AND list_has_any({_tokens('clause')}, ws)), y AS (SELECT trace_id, msg_idx, clause_no, arg_min(cue, mi) AS cue FROM x WHERE cue IS NOT NULL GROUP BY ALL) SELECT an.trace_id, an.msg_idx, kind, coalesce(cue, 'active') AS status FROM an LEFT JOIN y USING (trace_id, msg_idx, clause_no)",
        "memory_recall_topk": f"WITH w AS (SELECT doc_id AS fact_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents), tf AS (SELECT fact_id, w, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents), df AS (SELECT w, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY w), vec AS (SELECT fact_id, w, tf * idf AS v FROM tf JOIN df USING (w)), q AS (SELECT w, count(*) * any_value(idf) AS q FROM (SELECT unnest(regexp_extract_all('{RECALL_QUERY}', '[a-z0-9]+')) AS w) JOIN df USING (w) GROUP BY w), l AS (SELECT fact_id, sqrt(sum(v * v)) AS l FROM vec GROUP BY ALL), s AS (SELECT fact_id, round(sum(v * q) / (any_value(l) * (SELECT sqrt(sum(q * q)) FROM q)), 6) AS score FROM vec JOIN q USING (w) JOIN l USING (fact_id) GROUP BY fact_id) SELECT fact_id, score, CAST(row_number() OVER (ORDER BY score DESC, fact_id) AS INT) AS rank FROM s ORDER BY score DESC, fact_id LIMIT 10",
        "rescue_recurrence": f"WITH {_EVENTS}, {_arts(('error', 'number'))}, v AS (SELECT DISTINCT trace_id, value, msg_idx FROM a), z AS (SELECT *, max(msg_idx) OVER (PARTITION BY trace_id, value) AS last FROM v) SELECT trace_id, value, count(*) AS turns, round(sum(pow(0.85, last - msg_idx)), 6) AS recurrence FROM z GROUP BY trace_id, value",
        "store_resolve": f"WITH {_TALK} SELECT trace_id, msg_idx, role, content FROM m",
        "call_statistics": "SELECT coalesce(user_id, -1) AS user_id, count(*) AS calls, CAST(sum(CAST(event_type = 'error' AS BIGINT)) AS BIGINT) AS errors, round(avg(value), 6) AS mean_value FROM events GROUP BY ROLLUP (user_id)",
    }
