"""Column functions over message texts. All are built-in expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shapes of the values that a message can carry. Without look-around, so that other engines can run them as well.
PATTERNS = {
    "amount": r"[$][0-9][0-9,]*(?:[.][0-9]{2})?",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}",
    "error": r"Error: code [0-9]+|[A-Z][a-zA-Z]*(?:Error|Exception)",
    "hex": r"\b[0-9a-f]{16,}\b",
    "id": r"\b[A-Z]{2,}-[0-9]{4,12}\b",
    "number": r"\b[0-9]+(?:[.][0-9]+)?\b",
    "path": r"(?:/[A-Za-z0-9_.-]+){2,}",
    "state": r"\b[a-z_]+=[A-Za-z0-9.]+",
    "url": r"https?://[^ \n\t]+",
}
#: What every value of a kind has, and what is quickly looked for: texts without it aren't searched by the pattern.
_KNOWN = dict(PATTERNS)
_TELLS = {"amount": "$", "email": "@", "error": ("Error", "Exception"), "id": "-", "path": "/", "state": "=", "url": "://"}
#: Identifiers by the field they are of; further ones by ``config.register_pattern``.
DOMAIN_IDS = {
    "aviation": r"\b(?:PNR|FLT|TAIL)-[A-Z0-9]{3,10}\b",
    "banking": r"\b(?:ACCT-[0-9]{6,12}|SWIFT-[A-Z0-9]{8,11}|TXN-[A-Z0-9]{8,16}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7})\b",
    "cloud": r"\b(?:i-[0-9a-f]{8,17}|vol-[0-9a-f]{8,17}|arn:aws:[a-z0-9-]+:[A-Za-z0-9:/._-]+)",
    "commerce": r"\b(?:ORDER|ORD|SKU|CART|INV|RMA)-[A-Z0-9]{3,14}\b",
    "education": r"\b(?:STU|CRS|ENR)-[0-9]{3,10}\b",
    "energy": r"\b(?:MTR|GRID|WELL)-[A-Z0-9]{3,12}\b",
    "health": r"\b(?:MRN|NPI|RX|PAT)-?[0-9]{5,12}\b",
    "insurance": r"\b(?:CLM|POL|CLAIM|POLICY)-[A-Z0-9]{4,14}\b",
    "legal": r"\b(?:CASE|DKT|MATTER)-[A-Z0-9-]{3,14}\b",
    "logistics": r"\b(?:TRK|SHP|AWB|CNT)-?[A-Z0-9]{6,18}\b",
    "manufacturing": r"\b(?:LOT|BATCH|WO|PN)-[A-Z0-9]{3,14}\b",
    "security": r"\b(?:CVE-[0-9]{4}-[0-9]{4,7}|CWE-[0-9]{1,5})\b",
    "software": r"\b(?:[A-Z][A-Z0-9]{1,9}-[0-9]{1,6}|v[0-9]+[.][0-9]+[.][0-9]+)\b",
    "telecom": r"\b(?:IMEI|IMSI|SIM)-?[0-9]{10,19}\b",
}
#: Amounts with a sign or a code of their currency.
CURRENCY = r"(?:[$€£¥₹₩₽₺]) ?[0-9][0-9,]*(?:[.][0-9]{1,2})?|[0-9][0-9,]*(?:[.][0-9]{1,2})? ?(?:USD|EUR|GBP|JPY|INR|CNY|AUD|CAD|CHF)\b"
#: What notebook kernels and the like say by themselves.
INFRA_NOISE = r"(?i)nan json|jsondecodeerror: nan|ipykernel|kernel (?:died|restart)|deprecationwarning|futurewarning"
#: The kinds that link messages to each other.
LINKING = ("email", "error", "hex", "id", "path")


def token_count(text: Column) -> Column:
    """Runs of non-blanks and runs of blanks, both of which are tokens; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+|\s+"), F.lit(0)))


def matches(text: Column, kind: str) -> Column:
    """The distinct values of a kind in a text."""
    t = F.coalesce(text, F.lit(""))
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)))
    tells = (_TELLS[kind],) if isinstance(_TELLS.get(kind), str) else _TELLS.get(kind, ())
    if not tells or PATTERNS[kind] != _KNOWN.get(kind):
        return found
    has = F.contains(t, F.lit(tells[0]))
    for x in tells[1:]:
        has = has | F.contains(t, F.lit(x))
    return F.when(has, found).otherwise(F.expr("cast(array() as array<string>)"))


def domain_ids(text: Column) -> Column:
    """The distinct identifiers of all fields in a text."""
    t = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in DOMAIN_IDS.values()))))


def errors(text: Column) -> Column:
    """The distinct errors of a text, without what the infrastructure says by itself."""
    return F.filter(matches(text, "error"), lambda e: ~e.rlike(INFRA_NOISE))


def value_count(text: Column) -> Column:
    """How many distinct paths, identifiers, addresses and errors a text has."""
    kinds = [F.size(matches(text, k)) for k in ("path", "id", "hex", "url", "error")]
    total = kinds[0]
    for k in kinds[1:]:
        total = total + k
    return total


def value_density(text: Column) -> Column:
    """Values for each token."""
    return value_count(text) / F.greatest(token_count(text), F.lit(1))


def value_bonus(text: Column) -> Column:
    """How much a text weighs by having paths, identifiers, errors and numbers at all; at most 1."""
    part = lambda k, w, n=1: F.least(F.size(matches(text, k)) / n, F.lit(1.0)) * w
    return F.least(F.lit(1.0), part("path", 0.4) + part("id", 0.3) + part("error", 0.25) + part("number", 0.1, 3))


def spans(text: Column) -> Column:
    """All identifiers, paths, numbers and names in camel or snake case, repeats included."""
    t = F.coalesce(text, F.lit(""))
    names = r"\b[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]+)+\b|\b[a-z0-9]+(?:_[a-z0-9]+)+\b"
    return F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (PATTERNS["id"], PATTERNS["path"], PATTERNS["number"], names)))


def gapped(value: Column) -> Column:
    """A pattern that finds a value of several words whatever stands between them."""
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), F.array_join(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: w), "[^A-Za-z0-9]*"), F.lit("(?![A-Za-z0-9_])"))


def json_parts(text: str | None) -> list[str] | None:
    """The elements of a JSON list or object as they are written; None if it has fewer than two or isn't one."""
    import json

    s = (text or "").strip()
    try:
        whole = json.loads(s) if s[:1] in ("[", "{") else None
    except ValueError:
        return None
    if not isinstance(whole, (list, dict)) or len(whole) < 2:
        return None
    out, depth, quoted, skip, begin = [], 0, False, False, 1
    for i in range(1, len(s)):
        c = s[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
        elif (c == "," and depth == 0) or i == len(s) - 1:
            out.append(s[begin:i].strip())
            begin = i + 1
        elif c in "]}":
            depth -= 1
    return out if len(out) == len(whole) else None


def loose(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def recoverable(value: Column, text: Column) -> Column:
    """Whether a value can be read off a text: digits and words need a boundary, anything else is compared loosely."""
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    v = F.lower(value)
    return (
        F.when(F.length(value) == 0, F.lit(False))
        .when(value.rlike("^[0-9]+$"), F.regexp_like(low, F.concat(F.lit("[^0-9]"), v, F.lit("[^0-9]"))))
        .when(value.rlike("^[A-Za-z0-9_]+$"), F.regexp_like(low, F.concat(F.lit("[^a-z0-9_]"), v, F.lit("[^a-z0-9_]"))))
        .otherwise(F.contains(loose(text), loose(value)))
    )


def hashed_cells(messages: DataFrame, dim: int = 256) -> DataFrame:
    """(trace_id, msg_idx, i, v): signed feature hashing of the words ``[a-z0-9]+`` of contents by MD5; cells that aren't zero."""
    words = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    w = messages.select("trace_id", "msg_idx", F.explode(words).alias("w")).select("trace_id", "msg_idx", F.md5("w").alias("h"))
    i = F.pmod(F.conv(F.substring("h", 31, 2), 16, 10).cast("int"), F.lit(dim))
    sign = F.when(F.conv(F.substring("h", 30, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    return w.groupBy("trace_id", "msg_idx", i.alias("i")).agg(F.sum(sign).cast("int").alias("v")).where("v <> 0")


def similarity_to_first(messages: DataFrame, dim: int = 256) -> DataFrame:
    """(trace_id, msg_idx, similarity): cosine of hashed contents with the trace's first message; 0 for a message without words."""
    cells = hashed_cells(messages, dim)
    first = messages.groupBy("trace_id").agg(F.min("msg_idx").alias("msg_idx"))
    norm = cells.groupBy("trace_id", "msg_idx").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    task = cells.join(first, ["trace_id", "msg_idx"], "left_semi").select("trace_id", "i", F.col("v").alias("t"))
    task_norm = norm.join(first, ["trace_id", "msg_idx"], "left_semi").select("trace_id", F.col("norm").alias("task_norm"))
    dot = cells.join(task, ["trace_id", "i"]).groupBy("trace_id", "msg_idx").agg(F.sum(F.col("v") * F.col("t")).alias("dot"))
    joined = messages.select("trace_id", "msg_idx").join(dot, ["trace_id", "msg_idx"], "left").join(norm, ["trace_id", "msg_idx"], "left").join(task_norm, "trace_id", "left")
    return joined.select("trace_id", "msg_idx", F.coalesce(F.round(F.try_divide("dot", F.col("norm") * F.col("task_norm")), 5), F.lit(0.0)).alias("similarity"))
