"""Tool calls and results: repeats, runs, anomalies, values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracefold.functions import text as T


ERROR_WORDS = r"(?i)\b(?:error|fail(?:ed|ure|ing)?|exception|timeout|timed out|denied|refused|unreachable|crash(?:ed)?)\b"


def canonical(content: Column) -> Column:
    """JSON with its keys in order and without blanks, so that equal payloads are equal texts; other texts as they are."""
    return F.coalesce(F.try_parse_json(content).cast("string"), content)


def dedupe_results(messages: DataFrame, least_chars: int = 40) -> DataFrame:
    """(trace_id, msg_idx, same_as): tool results of at least ``least_chars`` that say what an earlier one of the trace does."""
    rows = messages.where(F.col("role") == "tool").where(F.length("content") >= least_chars)
    first = F.min("msg_idx").over(W.partitionBy("trace_id", F.sha2(canonical(F.col("content")), 256)))
    return rows.select("trace_id", "msg_idx", first.alias("same_as")).where("same_as < msg_idx")


def call_runs(messages: DataFrame, least: int = 3) -> DataFrame:
    """(trace_id, first_idx, last_idx, calls, tool_name, tool_args): runs of consecutive like calls (gaps and islands)."""
    calls = messages.where("tool_name is not null")
    order = W.partitionBy("trace_id").orderBy("msg_idx")
    new = F.coalesce((F.lag("tool_name").over(order) != F.col("tool_name")) | (F.lag("tool_args").over(order) != F.col("tool_args")), F.lit(True))
    runs = calls.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    g = runs.groupBy("trace_id", "run", "tool_name", "tool_args").agg(F.min("msg_idx").alias("first_idx"), F.max("msg_idx").alias("last_idx"), F.count("*").alias("calls"))
    return g.where(F.col("calls") >= least).select("trace_id", "first_idx", "last_idx", "calls", "tool_name", "tool_args")


def digits_masked(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]+", "#")


def paired(messages: DataFrame, *key: Column) -> DataFrame:
    """``messages`` with ``run``: a number for the calls that follow each other, results between them, and are alike in ``key``.

    A key may use the columns messages have and ``result``, the text of the tool result right after a call. Any message
    that is neither call nor such a result ends a run; it has no run itself. One shuffle, by trace.
    """
    order = W.partitionBy("trace_id").orderBy("msg_idx", "role")
    is_call = F.col("tool_name").isNotNull()
    after_call = (F.col("role") == "tool") & ~is_call & F.coalesce(F.lag(is_call).over(order), F.lit(False))
    rows = messages.withColumn("is_call", is_call).withColumn("is_result", after_call)
    rows = rows.withColumn("result", F.when(F.lead("is_result").over(order), F.lead("content").over(order)))
    rows = rows.withColumn("k", F.when(F.col("is_call"), F.to_json(F.struct(*(x.alias(f"k{i}") for i, x in enumerate(key))))))
    before = F.when(F.lag("is_result").over(order), F.lag("k", 2).over(order)).otherwise(F.lag("k").over(order))
    starts = F.when(F.col("is_call"), ~F.coalesce(before == F.col("k"), F.lit(False))).otherwise(~F.col("is_result"))
    return rows.withColumn("run", F.sum(starts.cast("int")).over(order)).withColumn("run", F.when(F.col("is_call") | F.col("is_result"), F.col("run"))).drop("k")


def collapse_runs(messages: DataFrame, least: int = 3) -> DataFrame:
    """Messages with the inner calls of each run of at least ``least``, and their results, replaced by one summary.

    Calls are of one run if nothing but their results stands between them and tools, arguments and results are the same but for
    digits; so messages of users are never touched, and a result that deviates ends the run. Runs in which more than one
    number of the arguments changes, or one that neither only grows nor only falls, stay as they are.
    """
    none = F.lit(None).cast("string")
    rows = paired(messages, F.col("tool_name"), digits_masked(F.coalesce("tool_args", F.lit(""))), digits_masked(F.coalesce("result", F.lit(""))))
    run = W.partitionBy("trace_id", "run")
    numbers = F.collect_list(F.when(F.col("is_call"), F.transform(F.regexp_extract_all(F.coalesce("tool_args", F.lit("")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("decimal(38,0)")))).over(run.orderBy("msg_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("ns", numbers).withColumn("calls", F.count(F.when(F.col("is_call"), 1)).over(run))
    rows = rows.withColumn("first_idx", F.min("msg_idx").over(run)).withColumn("last_call", F.max(F.when(F.col("is_call"), F.col("msg_idx"))).over(run)).withColumn("name", F.first("tool_name", ignorenulls=True).over(run))
    places = F.sequence(F.lit(0), F.size(F.get("ns", F.lit(0))) - 1)
    series = F.transform(F.when(F.size(F.get("ns", F.lit(0))) > 0, places).otherwise(F.expr("cast(array() as array<int>)")), lambda p: F.transform("ns", lambda xs: F.get(xs, p)))
    varying = F.filter(series, lambda xs: F.size(F.array_distinct(xs)) > 1)
    steady = F.size(F.filter(varying, lambda xs: (xs == F.array_sort(xs)) | (xs == F.reverse(F.array_sort(xs))))) == F.size(varying)
    safe = (F.col("run").isNotNull()) & (F.col("calls") >= least) & (F.size(varying) <= 1) & steady
    second = F.min(F.when(F.col("is_call") & (F.col("msg_idx") > F.col("first_idx")), F.col("msg_idx"))).over(run)
    rows = rows.withColumn("inner", F.coalesce(safe & (F.col("msg_idx") >= second) & (F.col("msg_idx") < F.col("last_call")), F.lit(False))).withColumn("note", F.coalesce(F.col("inner") & (F.col("msg_idx") == second), F.lit(False)))
    text = F.concat(F.lit("["), (F.col("calls") - 2).cast("string"), F.lit(" more '"), F.col("name"), F.lit("' calls]"))
    return rows.where("not inner or note").select("trace_id", "msg_idx", F.when(F.col("note"), "tool").otherwise(F.col("role")).alias("role"), F.when(F.col("note"), text).otherwise(F.col("content")).alias("content"), F.when(F.col("note"), none).otherwise(F.col("tool_name")).alias("tool_name"), F.when(F.col("note"), none).otherwise(F.col("tool_args")).alias("tool_args"))


def argument_shape(args: Column) -> Column:
    """The keys of a call's arguments with their types."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(args)), F.lit(""))


def anomalies(messages: DataFrame, least: int = 3) -> DataFrame:
    """(trace_id, msg_idx, content): results in runs of at least ``least`` calls of one shape whose digit-masked form isn't the run's most usual, or that speak of an error."""
    runs = paired(messages, F.col("tool_name"), argument_shape(F.col("tool_args")))
    rows = runs.where("is_result").withColumn("form", digits_masked(F.col("content")))
    counts = rows.groupBy("trace_id", "run", "form").agg(F.count("*").alias("n"))
    usual = counts.groupBy("trace_id", "run").agg(F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("u"), F.sum("n").alias("total")).where(F.col("total") >= least)
    return rows.join(usual, ["trace_id", "run"]).where((F.col("form") != F.col("u.form")) | F.col("content").rlike(ERROR_WORDS)).select("trace_id", "msg_idx", "content")


def candidate_tokens(text: Column) -> Column:
    """Tokens that look like identifiers or paths: of 3 to 40 characters with a digit, dash, slash or dot inside."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9][A-Za-z0-9_./-]{1,38}[A-Za-z0-9]"), F.lit(0)), lambda x: x.rlike("[0-9./-]")))


def anomaly_values(messages: DataFrame, least: int = 3) -> DataFrame:
    """(trace_id, value): the identifier-like tokens of anomalous results, to be preserved."""
    return anomalies(messages, least).select("trace_id", F.explode(candidate_tokens(F.col("content"))).alias("value")).distinct()


def observed(messages: DataFrame, least: int = 3) -> DataFrame:
    """(trace_id, msg_idx, kind, action, target, reason): an observation for each anomalous result that names an identifier, path or error.

    The action is the tool that was called, the reason the beginning of the result (200 characters, a feature of the operator).
    """
    order = W.partitionBy("trace_id").orderBy("msg_idx", "role")
    tools = messages.withColumn("action", F.lag("tool_name").over(order)).select("trace_id", "msg_idx", "action")
    first = F.coalesce(*(F.get(T.matches(F.col("content"), k), F.lit(0)) for k in ("id", "path", "error")))
    return anomalies(messages, least).withColumn("target", first).where("target is not null").join(tools, ["trace_id", "msg_idx"]).select("trace_id", "msg_idx", F.lit("observation").alias("kind"), F.coalesce("action", F.lit("tool_observation")).alias("action"), "target", F.substring("content", 1, 200).alias("reason"))


_DIGITS = re.compile("[0-9]+")
OMITTED = r"\s*\[\+[0-9]+ similar items omitted\]$"


def trimmed_array(content: str | None, least: int = 5, top: int = 3) -> str | None:
    """A JSON array of objects cut to those of unusual shape and the ``top`` best by a score-like field (or the first ``top``), with a note of how many are left out."""
    import json
    from collections import Counter

    try:
        rows = json.loads(content)
    except (TypeError, ValueError):
        return content
    if not isinstance(rows, list) or len(rows) < least or not all(isinstance(r, dict) for r in rows):
        return content

    def form(v) -> str:
        # digits don't make a text unusual, however many they are
        return "n" if isinstance(v, (int, float)) else f"s{len(_DIGITS.sub('#', v)) // 10}" if isinstance(v, str) else type(v).__name__

    forms = [tuple((k, form(r[k])) for k in sorted(r)) for r in rows]
    usual = Counter(forms).most_common(1)[0][0]
    keep = {i for i, f in enumerate(forms) if f != usual}
    score = next((k for k in rows[0] if any(x in k.lower() for x in ("score", "rank", "relevance"))), None)
    if score:
        keep |= set(sorted(range(len(rows)), key=lambda i: -(rows[i].get(score) if isinstance(rows[i].get(score), (int, float)) else 0))[:top])
    keep = keep or set(range(top))
    out = json.dumps([rows[i] for i in sorted(keep)], separators=(",", ":"), ensure_ascii=False)
    return out + (f"  [+{len(rows) - len(keep)} similar items omitted]" if len(keep) < len(rows) else "")


def trim_arrays(messages: DataFrame) -> DataFrame:
    """Messages with the JSON arrays of tool results trimmed, in Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None else trimmed_array(v))

    return _only_arrays(messages, run)


def rescalarise_arrays(messages: DataFrame) -> DataFrame:
    """Messages with the JSON arrays of tool results cut to scalars after the first rows, in Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if v is None else rescalarise(v))

    return _only_arrays(messages, run)


def _only_arrays(messages: DataFrame, run) -> DataFrame:
    looks = F.coalesce((F.col("role") == "tool") & F.ltrim("content").startswith("["), F.lit(False))
    return messages.where(looks).withColumn("content", run("content")).unionByName(messages.where(~looks))


def survivor_values(trimmed: DataFrame) -> DataFrame:
    """(trace_id, value): identifier-like tokens of the rows that trimming left, to be preserved."""
    rows = trimmed.where("role = 'tool'").where(F.col("content").rlike(OMITTED))
    return rows.select("trace_id", F.explode(candidate_tokens(F.regexp_replace("content", OMITTED, ""))).alias("value")).distinct()


STUB = r"^\[(?:dropped|values|rationale|comparative|referent|goal|state|preserved)\b[^\n]*\]?"


def without_ghosts(messages: DataFrame) -> DataFrame:
    """Messages with the text of stubs blanked, so that a value named in a stub doesn't count as still there."""
    return messages.withColumn("content", F.when(F.col("content").rlike(STUB), "").otherwise(F.col("content")))


def amounts(messages: DataFrame) -> DataFrame:
    """(trace_id, msg_idx, amount): amounts in any currency of at least two digits before the point; each at its first message."""
    rows = messages.select("trace_id", "msg_idx", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(T.CURRENCY), F.lit(0)))).alias("amount"))
    return rows.where(F.length(F.regexp_replace(F.split("amount", "[.]")[0], "[^0-9]", "")) >= 2).groupBy("trace_id", "amount").agg(F.min("msg_idx").alias("msg_idx")).select("trace_id", "msg_idx", "amount")


def uncaptured(messages: DataFrame, compressed: DataFrame) -> DataFrame:
    """Amounts of the originals that the compressed trace doesn't have."""
    return amounts(messages).join(amounts(compressed).select("trace_id", "amount"), ["trace_id", "amount"], "left_anti").select("trace_id", "msg_idx", "amount")


def value_stubs(messages: DataFrame, compressed: DataFrame, most: int = 15) -> DataFrame:
    """(trace_id, msg_idx, stub): '[values] ...' for each message whose amounts went missing, at most ``most`` values a trace (a feature of the operator)."""
    rank = F.row_number().over(W.partitionBy("trace_id").orderBy("msg_idx", "amount"))
    rows = uncaptured(messages, compressed).withColumn("r", rank).where(F.col("r") <= most)
    return rows.groupBy("trace_id", "msg_idx").agg(F.concat(F.lit("[values] "), F.array_join(F.sort_array(F.collect_list("amount")), ", ")).alias("stub"))


def compact_listing(content: str, least: int = 3, overlap: float = 0.7) -> str:
    """A JSON array of like objects as a header and rows: constant columns once, cells separated by a unit separator."""
    import json

    try:
        rows = json.loads(content)
    except (TypeError, ValueError):
        return content
    if not isinstance(rows, list) or len(rows) < least or not all(isinstance(r, dict) for r in rows):
        return content
    keys = [k for k in dict.fromkeys(k for r in rows for k in r) if sum(k in r for r in rows) >= overlap * len(rows)]
    if not keys or any(isinstance(r.get(k), (dict, list)) for r in rows for k in keys) or any(set(r) - set(keys) for r in rows):
        return content

    def cell(v) -> str:
        return "" if v is None else str(v).replace("\n", " ").replace("\x1f", " ")

    table = [[cell(r.get(k)) for k in keys] for r in rows]
    same = {i for i in range(len(keys)) if len({t[i] for t in table}) == 1}
    head = ["# " + "\x1f".join(keys[i] for i in range(len(keys)) if i not in same)] + [f"# {keys[i]}={table[0][i]}" for i in sorted(same)]
    out = "\n".join(head + ["\x1f".join(t[i] for i in range(len(keys)) if i not in same) for t in table])
    return out if len(out) < len(content) else content


def compact_listings(messages: DataFrame) -> DataFrame:
    """Messages with the JSON listings of tool results compacted, in Arrow batches; a text is never made longer."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else compact_listing(x))

    return _only_arrays(messages, run)


def literals(messages: DataFrame, longest: int = 1200, most: int = 200) -> DataFrame:
    """(trace_id, msg_idx, value): quoted strings and numbers of tool results up to ``longest`` characters, at most ``most`` a message (a feature of the operator)."""
    t = messages.where("role = 'tool'").where(F.length("content") <= longest)
    vs = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit('"([^"]{2,80})"'), F.lit(1)), F.regexp_extract_all("content", F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0))))
    return t.select("trace_id", "msg_idx", F.explode(F.slice(F.sort_array(vs), 1, most)).alias("value"))


def rescalarise(content: str, least: int = 5, top: int = 3) -> str:
    """A JSON array of objects with the first ``top`` whole and only short scalars of the others."""
    import json

    try:
        rows = json.loads(content)
    except (TypeError, ValueError):
        return content
    if not isinstance(rows, list) or len(rows) < least or not all(isinstance(r, dict) for r in rows):
        return content
    return json.dumps(rows[:top] + [{k: v for k, v in r.items() if v is None or isinstance(v, (bool, int, float)) or isinstance(v, str) and len(v) <= 80} for r in rows[top:]], separators=(",", ":"))
