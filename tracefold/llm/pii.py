"""PII by weak supervision.

Candidate spans get a vote (PII, not PII, or none) from each of several labelers: regular expressions,
gazetteers and contexts. Expectation maximisation (two classes, labelers independent given the class, abstaining
an outcome like the others) estimates each labeler's reliability from how votes agree, and so the
probability of each pattern of votes. A logistic regression on features of a span's shape and surroundings is then trained
on these probabilities, and it decides.

Scale: texts are read once; only spans (ids, offsets, votes and features, no text) are kept. Votes and features are
discrete, so EM and the classifier work on exact counts over all spans of the corpus, grouped by pattern: a
table whose size depends on the number of patterns (at most a few thousand), not on the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

NAMES = frozenset("alice anna antonio bernd carlos carmen charles claire david elena emma francois george hans heinrich helen henri isabel jacques james jean jennifer johann john jose juan julia karl katrin laura linda louis lucia luis margaret maria marie mary michael miguel monika patricia paul pedro peter pierre robert sabine sarah sofia stefan susan thomas ursula william wolfgang".split())
TLDS = frozenset("ai at au be br ca ch cn co com de edu es eu fr gov in info int io it jp me mil mx net nl org pl pt ru se uk us".split())
_SPAN = re.compile(
    r"(?P<setting>(?<![A-Za-z])(?i:passwor[dt]|passwd|pwd|contraseña|mot_de_passe|secret|token|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}[\"']?[^\s\"',;<>]{6,})"
    r"|(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)*)"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<secret>(?<![A-Za-z0-9_-])(?:AKIA|ghp_|sk-|xox[a-z]-)[A-Za-z0-9_-]{12,}|(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*\d)(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-]))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<number>(?<![\w.])(?:\d{13,19}|\+?\(?\d(?:[ ().\-/]{0,2}(?!\d{1,3}(?:\.\d{1,3}){3}(?!\w))\d){6,18})(?!\w))"
    r"|(?P<name>\b(?:" + "|".join(sorted(x.capitalize() for x in NAMES)) + r") [A-Z][a-z]{2,}\b)"
)
#: What every span has; texts without it are not looked at any further.
_SOME = r"[0-9@]|(?i:passwor[dt]|passwd|pwd|contraseña|mot_de_passe|secret|token|api[_-]?key)[ \t]*[=:]|AKIA|ghp_|sk-|xox|\b(?:" + "|".join(sorted(x.capitalize() for x in NAMES)) + r") [A-Z]"
_PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\+\d{9,14}")
_DATE = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{2,4}|(?:19|20)\d\d ?[-/] ?(?:19|20)\d\d")
_SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
_NEAR = {
    "email": re.compile(r"mail|contact|kontakt|write|schreib|correo|courriel|from|von|reply", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|client", re.I),
    "secret": re.compile(r"token|key|secret|passw|pwd|auth|bearer|credential|clave|jeton|schl[uü]ssel", re.I),
    "iban": re.compile(r"iban|konto|account|cuenta|compte", re.I),
    "number": re.compile(r"phone|tel|call|mobile|fax|card|visa|karte|tarjeta|carte|ssn|social|account|number|num[eé]ro|nummer", re.I),
    "name": re.compile(r"\b(?:mr|mrs|ms|dr|herr|frau|se[nñ]or|se[nñ]ora|monsieur|madame|name|by|contact)\b\.?", re.I),
}
_AGAINST = re.compile(r"(?:version|isbn|issn|doi|page|seite|p[aá]gina|figure|table|order|invoice|part|serial|[$€£#%=v])\s*$", re.I)
KINDS = ("email", "ip", "secret", "iban", "number", "name")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "against", "shape")


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


_KNOWN_KEY = re.compile(r"AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|xox[a-z]-[A-Za-z0-9-]{10,}")
_VALUE = re.compile(r"[=:][ \t]*[\"']?")


def found(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, kind) of the candidates of a text; of what is set to a secret only the secret."""
    for m in _SPAN.finditer(text):
        kind, s = m.lastgroup, m.start()
        if kind == "setting":
            kind, s = "secret", s + _VALUE.search(m.group()).end()
        yield s, m.end(), kind


def _letters(c: str) -> str:
    return "d" if c.isdigit() else "a" if c.isalpha() else "."


def votes(kind: str, span: str, before: str, after: str) -> tuple[str, str]:
    """(votes, features): a character '+', '-' or '0' for each labeler, and the span's discrete features."""
    digits = re.sub(r"\D", "", span)
    pattern = check = gaz = shape = "0"
    if kind == "email":
        local, _, domain = span.partition("@")
        pattern = "+" if re.fullmatch(r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+", span) else "-"
        gaz = "+" if domain.rpartition(".")[2].lower() in TLDS and "." in domain else "-"
        shape = "-" if len(domain) < 4 or not local else "0"
    elif kind == "ip":
        parts = [int(x) for x in span.split(".")]
        pattern = "+" if max(parts) < 256 and all(str(int(x)) == x for x in span.split(".")) else "-"
        shape = "-" if parts[0] in (0, 127, 255) or max(parts) < 20 else "+"
    elif kind == "secret":
        seen = len(set(span.lower())) / min(len(span), 24)
        pattern = "+" if re.fullmatch(r"[0-9a-fA-F]{24,}|(?:AKIA|ghp_|sk-|xox)[\w-]+", span) or seen > 0.55 else "-"
        mixed = sum(x != y for x, y in zip(map(_letters, span), map(_letters, span[1:]))) / len(span)
        shape = "+" if mixed > 0.2 or _KNOWN_KEY.fullmatch(span) else "-"
    elif kind == "iban":
        flat = span.replace(" ", "")
        pattern = "+" if 15 <= len(flat) <= 34 else "-"
        check = "+" if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else "-"
    elif kind == "number":
        if _DATE.fullmatch(span):
            pattern = "-"
        elif _SSN.fullmatch(span) or _PHONE.fullmatch(span) or (13 <= len(digits) <= 19 and re.fullmatch(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}", span)):
            pattern = "+"
        if 13 <= len(digits) <= 19:
            check = "+" if luhn(digits) else "0"
        gaz = "+" if span.startswith("+") or re.search(r"\b(?:555|800)\b", span) else "0"
        shape = "+" if 9 <= len(digits) <= 19 else "-"
    else:
        gaz = "+"
        shape = "+" if re.fullmatch(r"[A-Z][a-z]+ [A-Z][a-z]+", span) else "0"
    context = "+" if _NEAR[kind].search(before) or _NEAR[kind].search(after) else "0"
    against = "-" if _AGAINST.search(before) and kind in ("number", "ip", "iban") else "0"
    size = min(len(span) // 4, 9)
    form = "plain" if re.fullmatch(r"\d+|[0-9a-fA-F]+", span) else "led" if span[:1] in "+(" else "mixed"
    share = min(4, int(5 * len(digits) / len(span)))
    features = f"{kind}|size{size}|{form}|digits{share}|pattern{pattern}|check{check}|gaz{gaz}|near{context}|against{against}|shape{shape}"
    return "".join((pattern, check, gaz, context, against, shape)), features


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, kind, votes, features) of each candidate span; offsets in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            b = b.filter(pc.match_substring_regex(b.column(1), _SOME))
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for s, e, kind in found(text):
                    out.append((doc, s, e, kind, *votes(kind, text[s:e], text[max(0, s - 40) : s], text[e : e + 20])))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["doc_id", "start", "stop", "kind", "votes", "features"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, start int, stop int, kind string, votes string, features string")


def reliabilities(patterns: list[tuple[str, str]], counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over patterns (kind, votes): the probability of PII for each, and the outcome tables (kind, labeler, class, outcome).

    Every kind has labelers of its own. The prior is worth six spans of each class; it takes a vote to be right ten
    times as often as wrong for the pattern, three times for the others, so that a kind seen once or twice stays with
    what its labelers say.
    """
    outcome = {"-": 0, "0": 1, "+": 2}
    kinds = sorted({k for k, _ in patterns})
    k_of = np.array([kinds.index(k) for k, _ in patterns])
    v = np.array([[outcome[c] for c in x] for _, x in patterns])
    trust = np.array([10.0] + [3.0] * (len(LABELERS) - 1))
    prior = np.stack([np.array([[2 * t, 1 + t, 2.0], [2.0, 1 + t, 2 * t]]) * 2 / (1 + t) for t in trust])
    p = np.clip(0.5 + 0.2 * (v - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        table = np.zeros((len(kinds), *prior.shape))
        share = np.zeros(len(kinds))
        for k in range(len(kinds)):
            own = k_of == k
            share[k] = (counts[own] @ p[own] + 1) / (counts[own].sum() + 2)
            for j in range(len(LABELERS)):
                seen = prior[j].copy()
                for c in range(2):
                    np.add.at(seen[c], v[own, j], counts[own] * (p[own] if c else 1 - p[own]))
                table[k, j] = np.log(seen / seen.sum(1, keepdims=True))
        odds = np.log(share / (1 - share))[k_of] + (table[k_of[:, None], np.arange(len(LABELERS)), 1, v] - table[k_of[:, None], np.arange(len(LABELERS)), 0, v]).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, table


def one_hot(features: list[str]) -> tuple[np.ndarray, list[str]]:
    names = sorted({x for f in features for x in _cells(f)})
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(features), len(names)))
    for i, f in enumerate(features):
        x[i, [at[c] for c in _cells(f)]] = 1
    return x, names


def _cells(features: str) -> list[str]:
    kind, *rest = features.split("|")
    return [kind, *(f"{kind}:{r}" for r in rest)]


def classifier(features: list[str], p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each pattern of features, the probability that a logistic regression trained on soft labels gives."""
    x, _ = one_hot(features)
    x1 = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x1.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (counts * (q * (1 - q) + 1e-9))[:, None]).T @ x1 + 0.05 * np.eye(len(w)), x1.T @ (counts * (q - p)) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))


def spans(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (doc_id, start, stop, kind, score): the spans that the classifier takes for PII.

    Reads doc_id and text; offsets are in characters, stop excluded. Null doc_ids and null texts have no spans. Rows
    that are the same in doc_id and span count once. Scores of equal features are equal. Empty tables and tables
    without a candidate give no rows.
    """
    spark = docs.sparkSession
    found, _ = written(candidates(docs), "spans")
    groups = found.groupBy("kind", "votes", "features").count().orderBy("kind", "votes", "features").collect()
    counts = np.array([g["count"] for g in groups], float)
    patterns = sorted({(g.kind, g.votes) for g in groups})
    if not groups:
        return found.select("doc_id", "start", "stop", "kind", F.lit(0.0).alias("score"))
    at = np.array([patterns.index((g.kind, g.votes)) for g in groups])
    p, _ = reliabilities(patterns, np.bincount(at, counts, len(patterns)))
    names = sorted({g.features for g in groups})
    which = np.array([names.index(g.features) for g in groups])
    mass = np.bincount(which, counts, len(names))
    soft = np.bincount(which, counts * p[at], len(names)) / mass
    scores = classifier(names, soft, mass)
    model = spark.createDataFrame([(n, float(round(s, 9))) for n, s in zip(names, scores) if s >= threshold], "features string, score double")
    return found.join(model, "features").select("doc_id", "start", "stop", "kind", "score").distinct()


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every PII span replaced by its kind in brackets; rows without a doc_id or text stay as they are."""
    key, own = fresh(docs.columns, "key", "spans")
    per = spans(docs, threshold).groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "kind"))).alias(own))
    joined = docs.join(per, docs["doc_id"].cast("long") == per[key], "left")
    cut = F.aggregate(
        F.col(own),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.when(s.start < a.at, a).otherwise(F.struct(F.concat(a.done, F.substring(F.col("text"), a.at + 1, s.start - a.at), F.lit("["), s.kind, F.lit("]")).alias("done"), s.stop.alias("at"))),
        lambda a: F.concat(a.done, F.substring(F.col("text"), a.at + 1, F.length("text"))),
    )
    return joined.withColumn("text", F.when(F.col(own).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
