"""Message tables: (trace_id, msg_idx, role, content, tool_name, tool_args), one row a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("trace_id", "msg_idx", "role", "content", "tool_name", "tool_args")
ENVELOPES = ("messages", "trace", "conversation", "turns", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_conversations(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("int").alias("msg_idx"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_args"))


def from_documents(documents: DataFrame) -> DataFrame:
    """One message a document; a source is a trace."""
    from pyspark.sql import Window as W

    # the window sees keys only, so that no source's texts come together in one task
    keys = documents.select("doc_id", "source").withColumn("msg_idx", F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1)
    order = F.col("msg_idx")
    documents = documents.drop("msg_idx").join(keys.select(F.col("doc_id"), F.col("msg_idx")), "doc_id")
    return documents.select(F.col("source").alias("trace_id"), order.alias("msg_idx"), F.lit("user").alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_args"))


def from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Five messages an order: instruction, request, look-up, its lines as JSON (if any), confirmation.

    Tables are joined by the trace_id, so that what follows finds the messages of a trace in one partition. Messages are built by their
    number, each from its own expressions, rather than all five in one row.
    """
    part = lambda name, x: F.concat(F.lit(f'"{name}":'), F.coalesce(x.cast("long").cast("string"), F.lit("null")))
    line = F.concat(F.lit("{"), part("line", F.col("l_linenumber")), F.lit(","), part("part", F.col("l_partkey")), F.lit(","), part("qty", F.col("l_quantity").cast("int")), F.lit("}"))
    slim = lineitem.select(F.col("l_orderkey").cast("string").alias("trace_id"), "l_linenumber", "l_partkey", "l_suppkey", line.alias("x"))
    lines = slim.repartition("trace_id").groupBy("trace_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "x"))).getField("x"), ","), F.lit("]")).alias("lines"))
    joined = orders.select(F.col("o_orderkey").cast("string").alias("trace_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")).join(lines, "trace_id", "left")
    some = lambda *xs: F.array(*map(F.lit, xs))
    places = F.when(F.col("trace_id").isNull(), some(0)).when(F.col("lines").isNull(), F.when(F.col("cents").isNull(), some(0, 1, 2)).otherwise(some(0, 1, 2, 4))).when(F.col("cents").isNull(), some(0, 1, 2, 3)).otherwise(some(0, 1, 2, 3, 4))
    rows = joined.select("trace_id", "cents", "lines", F.explode(places).alias("msg_idx"))

    key = F.concat(F.lit("ORDER-"), F.lpad("trace_id", 8, "0"))
    refund = F.concat(F.lit(" has been cancelled. Refund of $"), F.floor(F.col("cents") / 100).cast("string"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"), F.lit(" is processed."))
    by = lambda *xs: F.when(F.col("msg_idx") == 0, xs[0]).when(F.col("msg_idx") == 1, xs[1]).when(F.col("msg_idx") == 2, xs[2]).when(F.col("msg_idx") == 3, xs[3]).otherwise(xs[4])
    content = by(F.lit("You are an order agent. Preserve order IDs."), F.concat(F.lit("Please cancel order "), key, F.lit(".")), F.concat(F.lit("Looking up "), key, F.lit(" now.")), F.col("lines"), F.concat(F.lit("Confirmed. "), key, refund))
    called = F.col("msg_idx") == 2
    return rows.select("trace_id", "msg_idx", by(*map(F.lit, ("system", "user", "assistant", "tool", "assistant"))).alias("role"), content.alias("content"), F.when(called, "get_order").alias("tool_name"), F.when(called, F.concat(F.lit('{"order_id":"'), key, F.lit('"}'))).alias("tool_args"))


def from_events(events: DataFrame) -> DataFrame:
    """One trace a user: every event is a tool call and its result."""
    from pyspark.sql import Window as W

    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    n = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1) * 2
    call = F.struct(F.lit(0).alias("d"), F.lit("assistant").alias("role"), F.lit("").alias("content"), F.lit("log_event").alias("tool_name"), F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('"}')).alias("tool_args"))
    result = F.struct(F.lit(1).alias("d"), F.lit("tool").alias("role"), F.concat(F.when(F.col("event_type") == "error", "Error: code ").otherwise("ok "), k).alias("content"), F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("tool_args"))
    numbered = events.withColumn("n", n)  # before the rows are doubled
    rows = numbered.select(F.col("user_id").cast("string").alias("trace_id"), "n", F.explode(F.array(call, result)).alias("m"))
    return rows.select("trace_id", (F.col("n") + F.col("m.d")).cast("int").alias("msg_idx"), "m.role", "m.content", "m.tool_name", "m.tool_args")


def from_json(raw: DataFrame, trace_id: str = "trace_id", body: str = "body", default_role: str = "assistant") -> DataFrame:
    """Messages of JSON texts: a list of messages, or an object that holds one under an envelope key.

    Contents may be texts, objects with text or content, or lists of blocks, of which only text blocks count; the role may be
    called role, sender, speaker or from; a tool call tool_call, tool_calls[0] or function. Anything else gives no message.
    """
    v = F.try_parse_json(F.col(body))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ENVELOPES))
    rows = raw.select(F.col(trace_id).cast("string").alias("trace_id"), F.posexplode(items).alias("msg_idx", "m"))

    def text(path: str, kind: str = "string") -> Column:
        return F.try_variant_get("m", path, kind)

    blocks = F.filter(F.try_variant_get("m", "$.content", "array<struct<type string, text string>>"), lambda b: b.text.isNotNull() & (F.coalesce(b.type, F.lit("text")) == "text"))
    plain = F.when(text("$.content").startswith("[") & blocks.isNotNull(), F.array_join(F.transform(blocks, lambda b: b.text), " ")).otherwise(text("$.content"))
    content = F.coalesce(text("$.content.text"), plain, text("$.text"), F.when(F.schema_of_variant("m") == "STRING", text("$")), F.lit(""))
    role = F.coalesce(*(F.nullif(F.trim(text(f"$.{k}")), F.lit("")) for k in ("role", "sender", "speaker", "from")), F.lit(default_role))
    tool = F.coalesce(text("$.tool_call.function.name"), text("$.tool_call.name"), text("$.tool_calls[0].function.name"), text("$.tool_calls[0].name"))
    args = F.coalesce(text("$.tool_call.function.arguments"), text("$.tool_call.args"), text("$.tool_calls[0].function.arguments"), text("$.tool_calls[0].args"))
    return rows.select("trace_id", "msg_idx", role.alias("role"), content.alias("content"), tool.alias("tool_name"), args.alias("tool_args"))


def read_json(spark: SparkSession, path: str, **kw) -> DataFrame:
    """One JSON document a file; the file's path is the trace_id."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), F.col("value").alias("body"))
    return from_json(raw, **kw)


def to_json(messages: DataFrame) -> DataFrame:
    """(trace_id, body): each trace as one JSON list, in order."""
    m = F.struct("msg_idx", "role", "content", F.when(F.col("tool_name").isNotNull(), F.struct(F.col("tool_name").alias("name"), F.col("tool_args").alias("args"))).alias("tool_call"))
    return messages.groupBy("trace_id").agg(F.to_json(F.sort_array(F.collect_list(m))).alias("body"))


def reshaped(content, text: str):
    """``text`` in the shape that a content had: a text, an object with a text, or blocks, of which the first text block takes it and the others go."""
    if content is None or isinstance(content, str):
        return None if content is None else text
    if isinstance(content, dict) and "text" in content:
        return {**content, "text": text}
    if isinstance(content, list):
        out, placed = [], False
        for block in content:
            is_text = isinstance(block, dict) and block.get("type") in ("text", None) and "text" in block
            if not is_text:
                out.append(block)
            elif not placed:
                out.append({**block, "text": text})
                placed = True
        return out if placed or not text else [{"type": "text", "text": text}, *out]
    return text


def with_call(message: dict, name: str | None, args) -> dict:
    """A message with its tool call where it had it: tool_call, or the first of tool_calls; a nested function keeps its form."""
    if name is None:
        return message

    def filled(call: dict) -> dict:
        if isinstance(call.get("function"), dict):
            return {**call, "function": {**call["function"], "name": name, "arguments": args}}
        return {**call, "name": name, "args": args}

    if isinstance(message.get("tool_call"), dict):
        return {**message, "tool_call": filled(message["tool_call"])}
    if isinstance(message.get("tool_calls"), list) and message["tool_calls"] and isinstance(message["tool_calls"][0], dict):
        return {**message, "tool_calls": [filled(message["tool_calls"][0]), *message["tool_calls"][1:]]}
    return {**message, "tool_call": {"name": name, "args": args}}


def restored(original, content: str, name: str | None, args: str | None):
    """A compressed message in its original's shape, with everything else that the original has."""
    import json

    if not isinstance(original, dict):
        return content
    key = "content" if "content" in original or "text" not in original else "text"
    out = {**original, key: reshaped(original.get(key), content or "")}
    call = original.get("tool_call") or (original.get("tool_calls") or [None])[0] or {}
    was = (call.get("function") or call).get("arguments", (call.get("function") or call).get("args")) if isinstance(call, dict) else None
    try:
        value = args if isinstance(was, str) or args is None else json.loads(args)
    except ValueError:
        value = args
    return with_call(out, name, value)


def denormalized(compressed: DataFrame, raw: DataFrame, trace_id: str = "trace_id", body: str = "body") -> DataFrame:
    """(trace_id, body): compressed traces in the shape of the raw JSON they came from: envelope, keys, content blocks, further fields.

    Messages are matched by msg_idx; one that the original doesn't have is added as it is, role and content.
    """
    import json

    import pandas as pd

    m = F.sort_array(F.collect_list(F.struct("msg_idx", "role", "content", "tool_name", "tool_args")))
    rows = raw.select(F.col(trace_id).cast("string").alias("trace_id"), F.col(body).alias("raw")).join(compressed.groupBy("trace_id").agg(F.to_json(m).alias("ms")), "trace_id")

    def one(text: str, ms: str) -> str:
        doc = json.loads(text)
        key = next((k for k in ENVELOPES if isinstance(doc, dict) and isinstance(doc.get(k), list)), None)
        originals = doc[key] if key else doc
        out = []
        for r in json.loads(ms):
            i = r["msg_idx"]
            known = isinstance(originals, list) and 0 <= i < len(originals)
            out.append(restored(originals[i], r.get("content") or "", r.get("tool_name"), r.get("tool_args")) if known else {"role": r.get("role"), "content": r.get("content") or ""})
        return json.dumps({**doc, key: out} if key else out, ensure_ascii=False, separators=(",", ":"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"trace_id": b.trace_id, "body": [one(t, x) for t, x in zip(b.raw, b.ms)]})

    return rows.mapInPandas(run, "trace_id string, body string")


def further_fields(raw: DataFrame, trace_id: str = "trace_id", body: str = "body") -> DataFrame:
    """(trace_id, msg_idx, extra): what messages have besides role, content and tool calls, as JSON; messages without any have no row."""
    v = F.try_parse_json(F.col(body))
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ENVELOPES))
    rows = raw.select(F.col(trace_id).cast("string").alias("trace_id"), F.posexplode(items).alias("msg_idx", "m"))
    known = ("role", "content", "text", "tool_call", "tool_calls", "sender", "speaker", "from")
    extra = F.map_filter(F.try_variant_get("m", "$", "map<string,variant>"), lambda k, _: ~k.isin(*known))
    return rows.select("trace_id", "msg_idx", extra.alias("e")).where("size(e) > 0").select("trace_id", "msg_idx", F.to_json("e").alias("extra"))


_REPORT_ROWS = 10_000


def write_report(rows: DataFrame, path: str, kind: str, most: int = _REPORT_ROWS) -> None:
    """A report as json, csv or parquet (written by executors), or as md or html by the driver: ``most`` rows, and a line that says how many there are besides."""
    if kind in ("json", "csv", "parquet"):
        getattr(rows.write.mode("overwrite"), kind)(path, **({"header": True} if kind == "csv" else {}))
        return
    import html as h

    got = [["" if v is None else str(v) for v in r] for r in rows.limit(most + 1).collect()]
    more = rows.count() - most if len(got) > most else 0
    got = got[:most] + ([[f"{more} more rows", *[""] * (len(rows.columns) - 1)]] if more else [])
    if kind == "md":
        text = "\n".join("| " + " | ".join(x) + " |" for x in [rows.columns, ["---"] * len(rows.columns), *got])
    elif kind == "html":
        text = "<table>" + "".join("<tr>" + "".join(f"<{t}>{h.escape(v)}</{t}>" for v in x) + "</tr>" for t, x in [("th", rows.columns), *(("td", g) for g in got)]) + "</table>"
    else:
        raise ValueError(f"no such kind of report: {kind}")
    with open(path, "w") as f:
        f.write(text + "\n")


class DictStore:
    """Originals held in a DataFrame of this session, for tests and notebooks; the interface of ``MessageStore``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows, self.version = spark, None, 0

    def save(self, messages: DataFrame) -> None:
        new = messages.select(*COLUMNS).withColumn("version", F.lit(self.version))
        self.rows, self.version = new if self.rows is None else self.rows.unionByName(new), self.version + 1

    def load(self) -> DataFrame:
        rows = self.rows if self.rows is not None else self.spark.createDataFrame([], "trace_id string, msg_idx int, role string, content string, tool_name string, tool_args string, version int")
        return rows.groupBy("trace_id", "msg_idx").agg(F.max_by(F.struct(*COLUMNS[2:]), "version").alias("m")).select("trace_id", "msg_idx", "m.*")

    def get(self, trace_id: str, msg_idx: int | None = None) -> DataFrame:
        rows = self.load().where(F.col("trace_id") == trace_id)
        return rows if msg_idx is None else rows.where(F.col("msg_idx") == msg_idx)

    def resolve(self, compressed: DataFrame) -> DataFrame:
        return resolve(compressed, self.load())


class MessageStore:
    """Originals by (trace_id, msg_idx), as Parquet; the last write of a message counts."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def save(self, messages: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("trace_id"), F.lit(self.buckets)).cast("int")
        messages.select(*COLUMNS).withColumn("saved_at", F.current_timestamp()).withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(self.path)

    def load(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows.groupBy("trace_id", "msg_idx").agg(F.max_by(F.struct(*COLUMNS[2:]), "saved_at").alias("m")).select("trace_id", "msg_idx", "m.*")

    def get(self, trace_id: str, msg_idx: int | None = None) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.lit(trace_id)), F.lit(self.buckets)).cast("int")
        rows = self.spark.read.parquet(self.path).where((F.col("bucket") == bucket) & (F.col("trace_id") == trace_id))
        rows = rows.groupBy("trace_id", "msg_idx").agg(F.max_by(F.struct(*COLUMNS[2:]), "saved_at").alias("m")).select("trace_id", "msg_idx", "m.*")
        return rows if msg_idx is None else rows.where(F.col("msg_idx") == msg_idx)

    def resolve(self, compressed: DataFrame) -> DataFrame:
        return resolve(compressed, self.load())


def resolve(compressed: DataFrame, originals: DataFrame) -> DataFrame:
    """Compressed messages with their original contents, or their own where there is no original."""
    o = originals.select("trace_id", "msg_idx", F.col("content").alias("original"))
    return compressed.join(o, ["trace_id", "msg_idx"], "left").select("trace_id", "msg_idx", "role", F.coalesce("original", "content").alias("content"))
