"""What stands between this engine and other libraries' objects. Nothing here is imported by the engine, and no client library by this module."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tracefold.config import Config


@dataclass(frozen=True)
class Runtime:
    """A tokenizer's ``encode`` and an embedder's ``encode``, either of which may be missing."""

    tokenizer: Callable[[str], list] | None = None
    embedder: object | None = None

    def use(self) -> Runtime:
        from tracefold.config import use_tokenizer

        use_tokenizer(self.tokenizer)
        return self


class HashingEmbedder:
    """Signed feature hashing of words, of length 1; the plain-Python twin of ``functions.text.hashed_cells``."""

    def __init__(self, dim: int = 256) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        import hashlib
        import re

        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall("[a-z0-9]+", t.lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                v[int(h[30:32], 16) % self.dim] += 1 if int(h[29], 16) % 2 == 0 else -1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n for x in v] if n else v)
        return out


def encoded(embedder, texts: list[str], most: int = 200, stride: int = 180) -> list[list[float]]:
    """Unit vectors; of a text of over ``most`` words the mean of its overlapping parts."""
    parts, of = [], []
    for i, t in enumerate(texts):
        w = t.split()
        for s in range(0, max(1, len(w) - most + stride), stride) if len(w) > most else (0,):
            parts.append(" ".join(w[s : s + most]) if len(w) > most else t)
            of.append(i)
    vectors = [list(map(float, v)) for v in embedder.encode(parts)] if parts else []
    out = []
    for i in range(len(texts)):
        own = [v for v, k in zip(vectors, of) if k == i]
        mean = [sum(x) / len(own) for x in zip(*own)]
        n = math.sqrt(sum(x * x for x in mean))
        out.append([x / n for x in mean] if n else mean)
    return out


def dimension(embedder) -> int:
    return len(embedder.encode(["probe"])[0])


class LocalModelEmbedder:
    """Any object with ``encode(list of texts)``, such as a sentence model that the caller has loaded."""

    def __init__(self, model) -> None:
        self.model = model

    def encode(self, texts: list[str]) -> list[list[float]]:
        return [list(map(float, v)) for v in self.model.encode(list(texts))]


class ClientEmbedder:
    """A caller's own client with ``embeddings.create(model, input)``, or with ``embed(texts, model, input_type)``."""

    def __init__(self, client, model: str, input_type: str = "search_document") -> None:
        self.client, self.model, self.input_type = client, model, input_type

    def encode(self, texts: list[str]) -> list[list[float]]:
        if hasattr(self.client, "embeddings"):
            return [list(x.embedding) for x in self.client.embeddings.create(model=self.model, input=list(texts)).data]
        return [list(v) for v in self.client.embed(texts=list(texts), model=self.model, input_type=self.input_type).embeddings]


class ChatClient:
    """A caller's own client as ``complete(prompt) -> text``: chat.completions.create, messages.create or chat.complete."""

    def __init__(self, client, model: str, most_tokens: int = 1024) -> None:
        self.client, self.model, self.most_tokens = client, model, most_tokens

    def complete(self, prompt: str) -> str:
        said = [{"role": "user", "content": prompt}]
        if hasattr(self.client, "messages"):
            return self.client.messages.create(model=self.model, max_tokens=self.most_tokens, messages=said).content[0].text
        chat = self.client.chat
        made = chat.completions.create(model=self.model, messages=said) if hasattr(chat, "completions") else chat.complete(model=self.model, messages=said)
        return made.choices[0].message.content


_KINDS = {"human": "user", "ai": "assistant", "system": "system", "tool": "tool", "function": "tool"}


def from_objects(items: list, trace_id: str = "trace") -> list[tuple]:
    """Rows of a message table from chat objects with ``type`` or ``role``, ``content`` and maybe ``tool_calls``."""
    import json

    rows = []
    for i, x in enumerate(items):
        role = getattr(x, "role", None) or _KINDS.get(getattr(x, "type", ""), "assistant")
        content = getattr(x, "content", "") or ""
        if isinstance(content, list):
            content = " ".join(b if isinstance(b, str) else str(b.get("text", "")) for b in content)
        call = (getattr(x, "tool_calls", None) or [None])[0]
        name, args = (call.get("name"), json.dumps(call.get("args") or {})) if isinstance(call, dict) else (None, None)
        rows.append((trace_id, i, role, content, name, args))
    return rows


def to_objects(rows: list, originals: list) -> list:
    """The original objects of compressed rows (msg_idx, content), copied with their new contents; rows without an original are left out."""
    import copy

    out = []
    for r in sorted(rows, key=lambda r: r.msg_idx):
        if 0 <= r.msg_idx < len(originals):
            x = copy.copy(originals[r.msg_idx])
            x.content = r.content
            out.append(x)
    return out


@dataclass
class Compressor:
    """Lists of chat objects in, shorter lists out; ``compress | model`` passes on to anything with ``invoke``."""

    spark: SparkSession
    cfg: Config = field(default_factory=Config)
    least_messages: int = 0
    then: object | None = None

    def invoke(self, items: list):
        from tracefold.operators.compress import MESSAGE
        from tracefold.plans.pipeline import run

        short = items
        if len(items) >= self.least_messages:
            m: DataFrame = self.spark.createDataFrame(from_objects(items), MESSAGE)
            short = to_objects(run(m, self.cfg).select("msg_idx", "content").collect(), items)
        return self.then.invoke(short) if self.then is not None else short

    def __or__(self, model) -> Compressor:
        return Compressor(self.spark, self.cfg, self.least_messages, model)

    def node(self, key: str = "messages") -> Callable[[dict], dict]:
        """A step of a graph of states: the state's messages, compressed."""
        return lambda state: {key: self.invoke(state[key])}
