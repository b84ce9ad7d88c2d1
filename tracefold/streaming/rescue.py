"""Stateful sessions: values of earlier decisions that later messages refer to are rescued.

State of a session: its last messages (bounded), their decisions and the graph between these, each value's decayed recurrence, and
the guaranteed set of values that have come up often. ``stream`` keeps it in the state store of Structured Streaming, keyed by trace,
with a time to live; ``replay`` runs the same kernel over whole traces and gives the same events whatever the micro-batches.

A message refers to a value on one of three tiers: it is still in what was last shipped (nothing to do), it is a critical value of
a decision in the window (tier 2), or it stands in the sentence of one (tier 3, only for values with a shape of their own).
A decision that leaves the window tries to place its values in the guaranteed set; what finds no room is told as lost.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracefold.functions import decide as D
from tracefold.functions.targets import bare_value

DECAY, PROMOTE, MOST_MESSAGES, MOST_GUARANTEED, ALPHA, HOPS, HOP_TOKENS = 0.85, 2.2, 200, 10, 0.15, 2, 400
EVENT = "trace_id string, msg_idx int, value string, owner_idx int, recurrence double, promoted boolean, tier int, displaced string, contributed array<string>"
_UPDATE = re.compile(r"\b(?:instead|changed?|actually|now|updated?|no longer|rather)\b", re.I)
_NAMES = re.compile(r"\b[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b|\b[a-z0-9]+(?:_[a-z0-9]+)+\b")
RESET = "reset"


def fresh() -> dict:
    return {"turn": 0, "before": None, "seen": {}, "guaranteed": {}, "capacity": MOST_GUARANTEED, "queue": [], "decisions": [], "shipped": None}


def capacity(budget: int) -> int:
    """Of the guaranteed set, for a budget of tokens."""
    return max(MOST_GUARANTEED, int(ALPHA * max(1, budget) / 10))


def referred(text: str) -> list[str]:
    """The paths, identifiers, numbers and names that a text has, lower-cased."""
    found = [m.group() for p in (D.PATHS, D.IDS, D.NUMBERS, _NAMES) for m in p.finditer(text)]
    return sorted({x.strip(".,").lower() for x in found if x})


def shaped(value: str) -> bool:
    """Whether a value is long enough and no bare number, so that finding it in a sentence means something."""
    return len(value) >= 4 and not value.replace(".", "").replace("-", "").isdigit()


def within_words(value: str, text: str) -> bool:
    gap = r"[^A-Za-z0-9]*".join(re.escape(x) for x in value.split())
    return re.search(rf"(?<![A-Za-z0-9_]){gap}(?![A-Za-z0-9_])", text, re.I) is not None


def supersedes(new: str, old: str) -> bool:
    """Whether a clause speaks of the same as another and says that it changed."""
    words = [{w for w in re.findall(r"[a-z0-9-]{3,}", x.lower())} for x in (new, old)]
    return bool(_UPDATE.search(new)) and len(words[0] & words[1]) >= 2


def promote(state: dict, value: str, clause: str) -> tuple[bool, str | None]:
    """(whether the value is guaranteed now, what had to go for it): in a full set only a value that the newcomer supersedes goes."""
    held = state["guaranteed"]
    if value in held:
        return True, None
    if len(held) < state["capacity"]:
        held[value] = clause
        return True, None
    old = next((v for v, c in held.items() if supersedes(clause, c)), None)
    if old is None:
        return False, None
    del held[old]
    held[value] = clause
    return True, old


def graph(decisions: list[dict]) -> dict[int, list[int]]:
    """From each decision (its place in the list) to the earlier ones of which a critical value is in its rationale."""
    owner: dict[str, list[int]] = {}
    for i, d in enumerate(decisions):
        for v in d["critical"]:
            owner.setdefault(v.lower(), []).append(i)
    return {j: sorted({i for r in d["rationale"] for i in owner.get(bare_value(r).lower(), []) if decisions[i]["msg_idx"] < d["msg_idx"]}) for j, d in enumerate(decisions)}


def walked(decisions: list[dict], node: int, shipped: str, hops: int = HOPS, most_tokens: int = HOP_TOKENS) -> list[int]:
    """The decisions upstream of one, up to ``hops`` away and within a budget, of which a value is no longer in what was shipped."""
    up, out, spent, seen, queue = graph(decisions), [], 0, {node}, [(node, 0)]
    while queue:
        at, depth = queue.pop(0)
        for i in up.get(at, []) if depth < hops else []:
            if i in seen:
                continue
            seen.add(i)
            values = decisions[i]["critical"]
            cost = sum(D.tokens(v) for v in values)
            if values and spent + cost <= most_tokens and not all(D.readable(v, shipped) for v in values):
                out.append(i)
                spent += cost
                queue.append((i, depth + 1))
    return out


def turn(state: dict, r: dict, hops: int = 0) -> list[tuple]:
    """Takes one message into a session; the events (msg_idx, value, owner_idx, recurrence, promoted, tier, displaced, contributed) that it causes.

    Tier 0 is a decision that left the window and took a value with it. What was last shipped is ``state["shipped"]``; as
    long as nobody sets it (``ship``), nothing counts as being there still. A message of role ``reset`` empties the session.
    """
    if r["role"] == RESET:
        state.clear()
        state.update(fresh())
        return []
    state["turn"] += 1
    text = " ".join(x for x in (r["content"], r["tool_args"]) if x)
    out, shipped = [], state["shipped"] or ""
    index: dict[str, int] = {}
    for i, d in enumerate(state["decisions"]):
        for v in d["critical"]:
            index[v.lower()] = i
    names = set(referred(text)) | {v for v in index if len(v) >= 4 and D.readable(v, text)}
    for v in sorted(names):
        if state["shipped"] is not None and D.readable(v, shipped):
            continue
        at, tier = index.get(v), 2
        if at is None and shaped(v):
            tier, at = 3, max((i for i, d in enumerate(state["decisions"]) if within_words(v, d["text"]) and D.decisive(d["text"])), key=lambda i: state["decisions"][i]["msg_idx"], default=None)
        if at is None:
            continue
        owner = state["decisions"][at]
        value = next((c for c in owner["critical"] if c.lower() == v), v)
        given = set(owner["critical"]) | {c for i in (walked(state["decisions"], at, shipped, hops) if hops else []) for c in state["decisions"][i]["critical"]}
        score, last = state["seen"].get(value, (0.0, state["turn"]))
        score = score * DECAY ** (state["turn"] - last) + 1
        state["seen"][value] = (score, state["turn"])
        was = value in state["guaranteed"]
        kept, displaced = promote(state, value, owner["text"]) if score >= PROMOTE else (False, None)
        out.append((r["msg_idx"], value, owner["msg_idx"], round(score, 6), kept and not was, tier, displaced, sorted(given)))
    d = D.decide(r["role"], r["content"], r["tool_name"], r["tool_args"], state["before"]) if r["role"] in ("assistant", "user") else None
    if d:
        state["decisions"].append({"msg_idx": r["msg_idx"], "critical": D.critical(d), "rationale": d["rationale"], "text": r["content"] or ""})
    state["before"] = r["content"]
    state["queue"].append(r["msg_idx"])
    if len(state["queue"]) > MOST_MESSAGES:
        old = state["queue"].pop(0)
        for d in [d for d in state["decisions"] if d["msg_idx"] == old]:
            state["decisions"].remove(d)
            for v in d["critical"]:
                if not promote(state, v, d["text"])[0]:
                    out.append((r["msg_idx"], v, old, 0.0, False, 0, None, []))
                    state["seen"].pop(v, None)
    return out


def ship(state: dict, compressed: list[dict], budget: int | None = None) -> set[str]:
    """Notes what was shipped, stubs left out, and the budget; the values to preserve in what is shipped next."""
    state["shipped"] = "\n".join(" ".join(x for x in (m["content"], m["tool_name"], m["tool_args"]) if x) for m in compressed if not re.match(r"\[(?:dropped|preserved|values|rationale)\b", m["content"] or ""))
    if budget is not None:
        state["capacity"] = capacity(budget)
    return set(state["guaranteed"])


def half_life() -> float:
    """After how many turns a recurrence is half."""
    return math.log(0.5) / math.log(DECAY)


_FIELDS = [x.split()[0] for x in EVENT.replace("array<string>", "a").split(", ")]


def replay(messages: DataFrame) -> DataFrame:
    """The events of whole traces, in order of msg_idx."""
    from tracefold.operators.compress import _grouped

    def kernel(rows: list[dict]) -> Iterator[dict]:
        state = fresh()
        for r in rows:
            for e in turn(state, r):
                yield dict(zip(_FIELDS, (r["trace_id"], *e)))

    return _grouped(messages, kernel, EVENT)


def preserving(messages: DataFrame, compressed: DataFrame, events: DataFrame) -> DataFrame:
    """Compressed traces with the values that the sessions rescued, at the end of the last message, where they aren't there already."""
    from tracefold.functions import text as T

    values = events.where("tier > 0").select("trace_id", F.explode("contributed").alias("value")).distinct()
    text = compressed.groupBy("trace_id").agg(F.concat_ws("\n", F.collect_list(F.concat_ws(" ", "content", "tool_name", "tool_args"))).alias("t"), F.max("msg_idx").alias("msg_idx"))
    missing = values.join(text, "trace_id").where(~T.recoverable(F.col("value"), F.col("t")))
    tags = missing.groupBy("trace_id", "msg_idx").agg(F.concat(F.lit("[preserved: "), F.array_join(F.array_sort(F.collect_set("value")), ", "), F.lit("]")).alias("tag"))
    return compressed.join(tags, ["trace_id", "msg_idx"], "left").withColumn("content", F.when(F.col("tag").isNull(), F.col("content")).otherwise(F.concat_ws("\n", F.nullif("content", F.lit("")), "tag"))).drop("tag")


def losses(events: DataFrame) -> DataFrame:
    """(trace_id, owner_idx, values): decisions that left a session's window with values that found no room."""
    return events.where("tier = 0").groupBy("trace_id", "owner_idx").agg(F.array_sort(F.collect_set("value")).alias("values"))


def stream(messages: DataFrame, ttl: str | None = "7 days") -> DataFrame:
    """The events of a streaming DataFrame of messages; messages of a trace have to arrive in order of msg_idx across batches."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = json.loads(state.get[0]) if state.exists else fresh()
        rows = sorted((r for b in batches for r in b.to_dict("records")), key=lambda r: r["msg_idx"])
        out = []
        for r in rows:
            r = {k: (None if v is None or v != v else v) for k, v in r.items()}
            out.extend((key[0], *e) for e in turn(session, r))
        state.update((json.dumps(session),))
        if ttl:
            state.setTimeoutDuration(ttl)
        yield pd.DataFrame(out, columns=_FIELDS)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return messages.select("trace_id", "msg_idx", "role", "content", "tool_name", "tool_args").groupBy("trace_id").applyInPandasWithState(run, EVENT, "session string", "append", timeout)


def rollup(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, user_id, calls, errors) of event-time windows with a watermark; also for batches."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "user_id")
    return w.agg(F.count("*").alias("calls"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors")).select(F.col("w.start").alias("start"), "user_id", "calls", "errors")
