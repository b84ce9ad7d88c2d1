"""Artifacts, decisions by rule, and the graph between messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.functions import text as T


def artifacts(messages: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(trace_id, msg_idx, role, kind, value): the distinct values of each kind (all that are registered) in each message."""
    kinds = tuple(T.PATTERNS) if kinds is None else kinds
    found = F.array(*(F.struct(F.lit(k).alias("kind"), T.matches(F.concat_ws(" ", "content", "tool_args"), k).alias("vs")) for k in kinds))
    return messages.select("trace_id", "msg_idx", "role", F.explode(found).alias("k")).select("trace_id", "msg_idx", "role", "k.kind", F.explode("k.vs").alias("value"))


def rule_decisions(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, kind, action, target) by three rules that need one message only.

    A tool call is an action, a polite request of a user a judgment, a text that begins with a confirming word a
    confirmation; the target is the first identifier. The full kernel is ``decisions.extract``.
    """
    ask = F.regexp_extract("content", "^(?i:please) ([a-z]+)", 1)
    kind = F.when(F.col("tool_name").isNotNull(), "action").when((F.col("role") == "user") & (ask != ""), "judgment").when(F.col("content").rlike("^Confirmed"), "confirmation")
    action = F.when(F.col("tool_name").isNotNull(), F.col("tool_name")).when((F.col("role") == "user") & (ask != ""), ask).when(F.col("content").rlike("^Confirmed"), "confirm")
    return messages.select("trace_id", "msg_idx", kind.alias("kind"), action.alias("action"), F.regexp_extract(F.concat_ws(" ", "content", "tool_args"), T.PATTERNS["id"], 0).alias("target")).where("kind is not null")


def first_producers(arts: DataFrame) -> DataFrame:
    """(trace_id, value, first_idx): where a value is seen first."""
    return arts.groupBy("trace_id", "value").agg(F.min("msg_idx").alias("first_idx"))


def _owned(arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, value, kind): every value of every message once, with the kind of the message's decision, if it has one."""
    return arts.select("trace_id", "msg_idx", "value").distinct().join(decisions.select("trace_id", "msg_idx", "kind"), ["trace_id", "msg_idx"], "left")


def dependency_edges(arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, value, origin, consumer): a decision depends on the earlier message that first had its value. Artifacts are read once."""
    first = F.min("msg_idx").over(W.partitionBy("trace_id", "value"))
    return _owned(arts, decisions).withColumn("origin", first).where("kind is not null and origin < msg_idx").select("trace_id", "value", "origin", F.col("msg_idx").alias("consumer"))


def attached(arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each decision with depends_on: how many earlier decisions first had one of its values."""
    edges = dependency_edges(arts, decisions).join(decisions.select("trace_id", F.col("msg_idx").alias("origin")), ["trace_id", "origin"], "left_semi").groupBy("trace_id", F.col("consumer").alias("msg_idx")).agg(F.countDistinct("origin").alias("n"))
    return decisions.join(edges, ["trace_id", "msg_idx"], "left").select("trace_id", "msg_idx", "kind", F.coalesce("n", F.lit(0)).alias("depends_on"))


def corroborated(arts: DataFrame, least: int = 2) -> DataFrame:
    """Values in at least ``least`` messages other than tool results."""
    return arts.where("role <> 'tool'").groupBy("trace_id", "value").agg(F.countDistinct("msg_idx").alias("messages")).where(F.col("messages") >= least)


def causal_edges(arts: DataFrame) -> DataFrame:
    """(trace_id, src, dst): from the message that first has a linking value to each later one that has it."""
    first = F.min("msg_idx").over(W.partitionBy("trace_id", "value"))
    return arts.select("trace_id", "msg_idx", "value").withColumn("src", first).where("src < msg_idx").select("trace_id", "src", F.col("msg_idx").alias("dst")).distinct()


def ancestors(edges: DataFrame) -> DataFrame:
    """(trace_id, node, ancestor): the transitive closure backwards.

    Each trace is closed by itself: its edges are sorted by destination, and a fold adds for each the ancestors of its
    source, which are complete since producers come before consumers. One shuffle, no iteration.
    """
    per = edges.groupBy("trace_id").agg(F.sort_array(F.collect_set(F.struct("dst", "src"))).alias("es"))
    empty = F.expr("cast(map() as map<int, array<int>>)")

    def add(m, e):
        up = F.array_union(F.array(e.src), F.coalesce(F.try_element_at(m, e.src), F.expr("cast(array() as array<int>)")))
        mine = F.array_union(F.coalesce(F.try_element_at(m, e.dst), F.expr("cast(array() as array<int>)")), up)
        return F.map_concat(F.map_filter(m, lambda k, v: k != e.dst), F.create_map(e.dst, mine))

    closed = per.select("trace_id", F.explode(F.aggregate("es", empty, add)).alias("node", "as"))
    return closed.select("trace_id", "node", F.explode("as").alias("ancestor"))


def confirming_descendants(messages: DataFrame, arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, descendant): later messages, before the next user message, that have a value of the decision."""
    after = W.partitionBy("trace_id").orderBy("msg_idx").rowsBetween(1, W.unboundedFollowing)
    until = messages.select("trace_id", "msg_idx", F.min(F.when(F.col("role") == "user", F.col("msg_idx"))).over(after).alias("until"))
    values = arts.select("trace_id", "msg_idx", "value").distinct()
    own = decisions.select("trace_id", "msg_idx").join(values, ["trace_id", "msg_idx"]).join(until, ["trace_id", "msg_idx"])
    later = values.select("trace_id", F.col("msg_idx").alias("descendant"), "value")
    return own.join(later, ["trace_id", "value"]).where("descendant > msg_idx and (until is null or descendant < until)").select("trace_id", "msg_idx", "descendant").distinct()


def minimal_set(messages: DataFrame, arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, msg_idx) of decisions, their ancestors and confirming descendants, system messages and the last user message."""
    d = decisions.select("trace_id", "msg_idx")
    up = ancestors(causal_edges(arts)).join(d.withColumnRenamed("msg_idx", "node"), ["trace_id", "node"], "left_semi").select("trace_id", F.col("ancestor").alias("msg_idx"))
    down = confirming_descendants(messages, arts, decisions).select("trace_id", F.col("descendant").alias("msg_idx"))
    system = messages.where("role = 'system'").select("trace_id", "msg_idx")
    last = messages.where("role = 'user'").groupBy("trace_id").agg(F.max("msg_idx").alias("msg_idx"))
    return d.unionByName(up).unionByName(down).unionByName(system).unionByName(last).distinct()


def compression_bound(messages: DataFrame, minimal: DataFrame) -> DataFrame:
    """(trace_id, messages, needed, bound): the share of messages that can go."""
    n = messages.groupBy("trace_id").agg(F.count("*").alias("messages"))
    k = minimal.groupBy("trace_id").agg(F.count("*").alias("needed"))
    return n.join(k, "trace_id", "left").select("trace_id", "messages", F.coalesce("needed", F.lit(0)).alias("needed"), F.round(1 - F.coalesce("needed", F.lit(0)) / F.col("messages"), 4).alias("bound"))


def idf(messages: DataFrame, arts: DataFrame, smooth: float = 1.0) -> DataFrame:
    """(trace_id, value, frequency, idf): ln((n + s) / (f + s)) + 1 within a trace."""
    n = messages.groupBy("trace_id").agg(F.count("*").alias("n"))
    f = arts.groupBy("trace_id", "value").agg(F.countDistinct("msg_idx").alias("frequency"))
    return f.join(n, "trace_id").select("trace_id", "value", "frequency", F.round(F.log((F.col("n") + smooth) / (F.col("frequency") + smooth)) + 1, 6).alias("idf"))


WEIGHTS = {"action": 2.0, "judgment": 1.5, "confirmation": 1.0}


def _shared(messages: DataFrame, arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, value, d, kind, idf): the messages and the decisions that share a value; artifacts, decisions and messages are read once each."""
    n = messages.groupBy("trace_id").agg(F.count("*").alias("n"))
    per = _owned(arts, decisions).groupBy("trace_id", "value").agg(F.collect_list("msg_idx").alias("ms"), F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(F.col("msg_idx").alias("d"), "kind"))).alias("ds"))
    per = per.where(F.size("ds") > 0).withColumn("frequency", F.size(F.array_distinct("ms"))).join(n, "trace_id")
    rows = per.select("trace_id", "value", F.round(F.log((F.col("n") + 1.0) / (F.col("frequency") + 1.0)) + 1, 6).alias("idf"), F.array_distinct("ms").alias("ms"), F.explode("ds").alias("x"))
    return rows.select("trace_id", F.explode("ms").alias("msg_idx"), "value", "x.d", "x.kind", "idf")


def centrality(messages: DataFrame, arts: DataFrame, decisions: DataFrame, tau: float = 5.0) -> DataFrame:
    """(trace_id, msg_idx, centrality): sum of idf * weight * exp(-distance / tau) over the values shared with decisions."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")]
    part = F.col("idf") * weight * F.exp(-F.greatest(F.col("d") - F.col("msg_idx"), F.lit(0)) / tau)
    return _shared(messages, arts, decisions).groupBy("trace_id", "msg_idx").agg(F.round(F.sum(part), 6).alias("centrality"))


def causal_flow(messages: DataFrame, arts: DataFrame, decisions: DataFrame, tau: float = 5.0) -> DataFrame:
    """(trace_id, msg_idx, decision, flow): idf * exp(-distance / tau) over values shared with an earlier message, as coordinates."""
    rows = _shared(messages, arts, decisions).where("msg_idx < d").withColumnRenamed("d", "decision")
    return rows.groupBy("trace_id", "msg_idx", "decision").agg(F.round(F.sum(F.col("idf") * F.exp((F.col("msg_idx") - F.col("decision")) / tau)), 6).alias("flow"))


def _by_matrix(flow: DataFrame, name: str, per_row: bool, kernel) -> DataFrame:
    """A kernel over the flow matrices of traces: batches are cut at traces, and matrices of one size go through the kernel together.

    The kernel gets an array (traces, messages, decisions) and gives one number a trace, or with ``per_row`` one a message.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        rest = None
        for b in batches:
            b = pa.Table.from_batches([b])
            t = b if rest is None else pa.concat_tables([rest, b])
            if not t.num_rows:
                continue
            ids = t.column("trace_id").to_numpy(zero_copy_only=False)
            cut = int(np.argmax(ids == ids[-1]))
            rest = t.slice(cut)
            yield from told(t.slice(0, cut))
        if rest is not None:
            yield from told(rest)

    def told(t):
        if not t.num_rows:
            return
        ids, i, j, x = (t.column(k).to_numpy(zero_copy_only=False) for k in ("trace_id", "msg_idx", "decision", "flow"))
        new = np.r_[True, ids[1:] != ids[:-1]]
        trace, names = np.cumsum(new) - 1, ids[new]
        row = np.cumsum(new | np.r_[True, i[1:] != i[:-1]]) - 1  # rows are sorted by trace and message
        row -= row[np.flatnonzero(new)][trace]
        order = np.lexsort((j, trace))
        fresh = np.r_[True, (j[order][1:] != j[order][:-1]) | (trace[order][1:] != trace[order][:-1])]
        col = np.empty(len(j), np.int64)
        col[order] = np.cumsum(fresh) - 1
        col -= np.minimum.reduceat(col, np.flatnonzero(new))[trace]
        height, width = (np.maximum.reduceat(k, np.flatnonzero(new)) + 1 for k in (row, col))
        for h, w in sorted(set(zip(height.tolist(), width.tolist()))):
            mine = np.flatnonzero((height == h) & (width == w))
            step = max(1, 4_000_000 // (h * w))
            for s in range(0, len(mine), step):
                some = mine[s : s + step]
                place = np.full(len(names), -1)
                place[some] = np.arange(len(some))
                at = place[trace] >= 0
                m = np.zeros((len(some), h, w))
                np.add.at(m, (place[trace[at]], row[at], col[at]), x[at])
                got = kernel(m)
                if per_row:
                    said = np.zeros((len(some), h), i.dtype)
                    said[place[trace[at]], row[at]] = i[at]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[some], h), pa.string()), pa.array(said.ravel(), pa.int32()), pa.array(got.ravel())], ["trace_id", "msg_idx", name])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.string()), pa.array(got)], ["trace_id", name])

    schema = f"trace_id string, {'msg_idx int, ' if per_row else ''}{name} double"
    return flow.select("trace_id", "msg_idx", "decision", "flow").repartition("trace_id").sortWithinPartitions("trace_id", "msg_idx", "decision").mapInArrow(run, schema)


def explained_variance(flow: DataFrame, k: int = 1) -> DataFrame:
    """(trace_id, explained): the share of the ``k`` greatest singular values of a trace's flow matrix in the sum of their squares."""
    import numpy as np

    def share(m):
        s = np.linalg.svd(m, compute_uv=False) ** 2
        total = s.sum(1)
        return np.round(np.divide(s[:, :k].sum(1), total, out=np.zeros(len(m)), where=total != 0), 6)

    return _by_matrix(flow, "explained", False, share)


def spectral_importance(flow: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, importance): row sums of U^2 S^2 of each trace's flow matrix, over their maximum. A kernel in batches for the SVD."""
    import numpy as np

    def importance(m):
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        v = (u**2 * s[:, None, :] ** 2).sum(2)
        most = v.max(1, keepdims=True)
        return np.divide(v, most, out=v, where=most != 0)

    return _by_matrix(flow, "importance", True, importance)


def evidence_gate(messages: DataFrame, arts: DataFrame, decisions: DataFrame, least_tools: int = 2, density: float = 0.3, least_corroboration: int = 2) -> DataFrame:
    """Judgments and confirmations with tools_before and passes: whether tool results before them are evidence enough."""
    before = W.partitionBy("trace_id").orderBy("msg_idx").rowsBetween(W.unboundedPreceding, -1)
    seen = messages.select("trace_id", "msg_idx", F.coalesce(F.sum((F.col("role") == "tool").cast("int")).over(before), F.lit(0)).alias("tools"), F.count("*").over(before).alias("n"))
    rows = decisions.where("kind <> 'action'").join(seen, ["trace_id", "msg_idx"])
    # a trace's decisions are held against its messages within one row, without pairing them up
    told = messages.where("role in ('tool', 'assistant')").groupBy("trace_id").agg(F.collect_list(F.struct("msg_idx", F.lower("content").alias("t"))).alias("told"))
    per = decisions.where("kind <> 'action'").groupBy("trace_id").agg(F.collect_list(F.struct("msg_idx", F.lower("target").alias("target"))).alias("ds")).join(told, "trace_id", "left")
    count = F.transform("ds", lambda d: F.struct(d.msg_idx.alias("msg_idx"), F.when(F.length(d.target) >= 3, F.size(F.filter(F.coalesce("told", F.expr("cast(array() as array<struct<msg_idx:int,t:string>>)")), lambda m: (m.msg_idx < d.msg_idx) & F.contains(m.t, d.target)))).otherwise(0).alias("hits")))
    hits = per.select("trace_id", F.explode(count).alias("h")).groupBy("trace_id", "h.msg_idx").agg(F.max("h.hits").alias("hits"))
    rows = rows.join(hits, ["trace_id", "msg_idx"], "left")
    ok = (
        F.when((F.col("msg_idx") <= 0) | (F.col("tools") == 0), True)
        .when(F.col("tools") < least_tools, False)
        .when(F.col("tools") / F.greatest("n", F.lit(1)) < density, False)
        .when((F.col("kind") != "confirmation") | (F.length("target") < 3), True)
        .otherwise(F.coalesce("hits", F.lit(0)) >= least_corroboration)
    )
    return rows.select("trace_id", "msg_idx", "kind", F.col("tools").cast("long").alias("tools_before"), ok.alias("passes"))


def referent_links(messages: DataFrame, lookback: int = 30) -> DataFrame:
    """(trace_id, msg_idx, anchor): a terse confirmation and the nearest earlier message, within ``lookback``, that names an identifier."""
    has = T.matches(F.col("content"), "id")
    order = W.partitionBy("trace_id").orderBy("msg_idx")
    anchor = F.last(F.when(F.size(has) > 0, F.col("msg_idx")), ignorenulls=True).over(order.rowsBetween(-lookback, -1))
    terse = F.trim(F.col("content")).rlike("^(?i:done|ok|okay|yes|sure|confirmed|agreed|go ahead|looks good|sounds good)[.!]?$")
    return messages.select("trace_id", "msg_idx", anchor.alias("anchor"), (terse & (F.size(has) == 0)).alias("is")).where("is and anchor is not null").select("trace_id", "msg_idx", "anchor")


def chain_integrity(messages_kept: DataFrame, arts: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, edges, intact, rci): the share of dependency edges of which both messages are kept; no edges give no row."""
    keep = messages_kept.select("trace_id", "msg_idx").distinct()
    e = dependency_edges(arts, decisions)
    a = keep.select("trace_id", F.col("msg_idx").alias("origin"), F.lit(1).alias("o"))
    b = keep.select("trace_id", F.col("msg_idx").alias("consumer"), F.lit(1).alias("c"))
    g = e.join(a, ["trace_id", "origin"], "left").join(b, ["trace_id", "consumer"], "left").groupBy("trace_id").agg(F.count("*").alias("edges"), F.count(F.col("o") + F.col("c")).alias("intact"))
    return g.select("trace_id", "edges", "intact", F.round(F.col("intact") / F.col("edges"), 4).alias("rci"))


# --- extended edges, integrity, repair


def critical_edges(decisions: DataFrame) -> DataFrame:
    """(trace_id, value, consumer): the critical values of full decisions (those of ``compress.extract``, with vals and target)."""
    target = F.when(F.length("target").between(2, 60), F.array("target")).otherwise(F.expr("cast(array() as array<string>)"))
    return decisions.select("trace_id", F.explode(F.array_distinct(F.concat("vals", target))).alias("value"), F.col("msg_idx").alias("consumer"))


def extended_edges(arts: DataFrame, rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, value, consumer): dependency edges and critical values, each once."""
    base = dependency_edges(arts, rules).select("trace_id", "value", "consumer")
    return base.unionByName(critical_edges(decisions)).distinct()


def checked(edges: DataFrame, compressed: DataFrame) -> DataFrame:
    """``edges`` with ``preserved``: whether the value can be read off the compressed trace, in whatever spelling."""
    text = compressed.groupBy("trace_id").agg(F.concat_ws("\n", F.collect_list(F.concat_ws(" ", "content", "tool_name", "tool_args"))).alias("t"))
    return edges.join(text, "trace_id", "left").withColumn("preserved", F.coalesce(T.recoverable(F.col("value"), F.col("t")), F.lit(False))).drop("t")


def extended_integrity(edges: DataFrame, compressed: DataFrame) -> DataFrame:
    """(trace_id, edges, preserved, rci) over the edges of ``extended_edges``; a trace without an edge has no row."""
    g = checked(edges, compressed).groupBy("trace_id").agg(F.count("*").alias("edges"), F.sum(F.col("preserved").cast("long")).alias("preserved"))
    return g.withColumn("rci", F.round(F.col("preserved") / F.col("edges"), 4))


def owners(values: DataFrame, messages: DataFrame) -> DataFrame:
    """(trace_id, value, owner, role): the first message of the original trace off which a value can be read.

    A trace's values are held against its messages within one row, without pairing them up.
    """
    rows = messages.select("trace_id", "msg_idx", "role", F.concat_ws(" ", "content", "tool_name", "tool_args").alias("t"))
    per = values.groupBy("trace_id").agg(F.collect_set("value").alias("vs")).join(rows.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("msg_idx", "role", "t"))).alias("ms")), "trace_id")
    found = F.transform("vs", lambda v: F.struct(v.alias("value"), F.get(F.filter("ms", lambda m: T.recoverable(v, m.t)), F.lit(0)).alias("o")))
    return per.select("trace_id", F.explode(found).alias("f")).where("f.o is not null").select("trace_id", "f.value", F.col("f.o.msg_idx").alias("owner"), F.col("f.o.role").alias("role"))


def repaired(messages: DataFrame, compressed: DataFrame, edges: DataFrame, floor: float = 1.0, most_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(compressed traces with what they lost, report): one pass, so that a second one finds nothing to do that the first could.

    Traces whose share of preserved edges is below ``floor`` get each missing value once, behind the message that first had
    it, or in a message of its own where that is gone; values are taken by first use, and one that goes over ``most_tokens`` is
    passed over, not the end. The report has (trace_id, added, tokens, shortfall, rci_before): shortfall are values that are over
    the budget or in no message.
    """
    c = checked(edges, compressed)
    rci = c.groupBy("trace_id").agg(F.round(F.avg(F.col("preserved").cast("double")), 4).alias("rci_before"))
    lost = c.where("not preserved").groupBy("trace_id", "value").agg(F.min("consumer").alias("consumer")).join(rci.where(F.col("rci_before") < floor), "trace_id")
    known = owners(lost, messages).select("trace_id", "value", "owner", "role")
    all_lost = lost.join(known, ["trace_id", "value"], "left").withColumn("cost", F.when(F.col("owner").isNotNull(), T.token_count(F.col("value"))))
    per = all_lost.groupBy("trace_id", "rci_before").agg(F.sort_array(F.collect_list(F.struct("consumer", "value", "owner", "role", "cost"))).alias("vs"))
    if most_tokens is None:
        taken = F.filter("vs", lambda v: v.owner.isNotNull())
    else:
        empty = F.expr("cast(array() as array<struct<consumer:int,value:string,owner:int,role:string,cost:int>>)")
        fold = F.aggregate("vs", F.struct(F.lit(0).alias("spent"), empty.alias("out")), lambda a, v: F.when(v.owner.isNotNull() & (a.spent + v.cost <= most_tokens), F.struct((a.spent + v.cost).alias("spent"), F.concat(a.out, F.array(v)).alias("out"))).otherwise(a))
        taken = fold.out
    per = per.withColumn("taken", taken)
    report = per.select("trace_id", F.size("taken").alias("added"), F.aggregate("taken", F.lit(0), lambda a, v: a + v.cost).alias("tokens"), F.transform(F.array_except("vs", "taken"), lambda v: v.value).alias("shortfall"), "rci_before")
    stubs = per.select("trace_id", F.explode("taken").alias("v")).groupBy("trace_id", F.col("v.owner").alias("msg_idx"), F.col("v.role").alias("owner_role")).agg(F.sort_array(F.collect_list("v.value")).alias("values"))
    none = F.lit(None).cast("string")
    j = compressed.join(stubs, ["trace_id", "msg_idx"], "full")
    added = F.concat_ws(" ", F.transform("values", lambda v: F.concat(F.lit("[repaired: "), v, F.lit("]"))))
    alone = F.concat_ws(" ", F.transform("values", lambda v: F.concat(F.lit("[repaired from dropped message: "), v, F.lit("]"))))
    content = F.when(F.col("values").isNull(), F.col("content")).when(F.col("role").isNull(), alone).otherwise(F.concat_ws(" ", F.nullif("content", F.lit("")), added))
    out = j.select("trace_id", "msg_idx", F.coalesce("role", "owner_role").alias("role"), content.alias("content"), F.coalesce("tool_name", none).alias("tool_name"), F.coalesce("tool_args", none).alias("tool_args"))
    return out, report


# --- loss of decisions


def decision_loss(edges: DataFrame, compressed: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, loss): the mean share of missing critical values over decisions, weighted by their kind; 0 where a decision has none."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")]
    missing = checked(edges, compressed).groupBy("trace_id", F.col("consumer").alias("msg_idx")).agg(F.avg((~F.col("preserved")).cast("double")).alias("missing"))
    j = decisions.select("trace_id", "msg_idx", F.coalesce(weight, F.lit(1.0)).alias("w")).join(missing, ["trace_id", "msg_idx"], "left")
    return j.groupBy("trace_id").agg(F.round(F.sum(F.col("w") * F.coalesce("missing", F.lit(0.0))) / F.sum("w"), 6).alias("loss"))


def marginal_loss(edges: DataFrame, compressed: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(trace_id, candidate, gain): how much of the loss each further text (trace_id, candidate, text) would take away by itself."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kind")]
    c = checked(edges, compressed)
    size = c.groupBy("trace_id", "consumer").agg(F.count("*").alias("n"))
    total = decisions.groupBy("trace_id").agg(F.sum(F.coalesce(weight, F.lit(1.0))).alias("total"))
    own = decisions.select("trace_id", F.col("msg_idx").alias("consumer"), F.coalesce(weight, F.lit(1.0)).alias("w"))
    lost = c.where("not preserved").join(size, ["trace_id", "consumer"]).join(own, ["trace_id", "consumer"]).join(total, "trace_id").withColumn("part", F.col("w") / F.col("n") / F.col("total"))
    per = lost.groupBy("trace_id").agg(F.collect_list(F.struct("value", "part")).alias("ls"))
    gain = F.aggregate(F.filter("ls", lambda v: T.recoverable(v.value, F.col("text"))), F.lit(0.0), lambda a, v: a + v.part)
    return candidates.join(per, "trace_id", "left").select("trace_id", "candidate", F.round(F.coalesce(gain, F.lit(0.0)), 6).alias("gain"))


def decision_graph(edges: DataFrame, decisions: DataFrame) -> DataFrame:
    """(trace_id, src, dst): an earlier decision of which a critical value is in the rationale of a later one."""
    owner = edges.select("trace_id", F.lower("value").alias("v"), F.col("consumer").alias("src"))
    bare = F.transform("rationale", lambda r: F.lower(F.trim(F.regexp_replace(r, r"^[^:=]*[:=]\s*", ""))))
    why = decisions.select("trace_id", F.col("msg_idx").alias("dst"), F.explode(F.array_distinct(bare)).alias("v"))
    return owner.join(why, ["trace_id", "v"]).where("src < dst").select("trace_id", "src", "dst").distinct()


def upstream(graph: DataFrame) -> DataFrame:
    """(trace_id, node, sources): the decisions that lead to each one."""
    return graph.groupBy("trace_id", F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("sources"))
