"""Knobs of the compressor and what can be plugged in: tokenizers, embedders, message adapters, value patterns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from tracefold.functions import decide as D
from tracefold.functions import text as T


@dataclass(frozen=True)
class Config:
    """Immutable, so that it can be part of a kernel's closure."""

    reduction: float = 0.87
    budget: int | None = None
    gamma: float = 0.72
    method: str = "compress"
    dedupe_tools: bool = True
    compact_listings: bool = True
    collapse_runs: bool = True
    least_run: int = 3
    prune_filler: bool = False
    value_stubs: bool = False
    rationale_stubs: bool = False
    anchor_stubs: bool = False
    repair: bool = False
    trim_arrays: bool = False
    strict: bool = False

    def with_(self, **changes) -> Config:
        return replace(self, **changes)


ADAPTERS: dict[str, Callable[[object], dict]] = {}


def adapter(name: str) -> Callable:
    """Registers a function that makes a message of some object: role, content, and optionally tool_name and tool_args."""

    def keep(f: Callable[[object], dict]) -> Callable[[object], dict]:
        ADAPTERS[name] = f
        return f

    return keep


@adapter("pair")
def _pair(x) -> dict:
    return {"role": x[0], "content": x[1]}


@adapter("object")
def _object(x) -> dict:
    return {"role": getattr(x, "role", None) or getattr(x, "type", "assistant"), "content": getattr(x, "content", "") or ""}


def adapted(name: str, items: list, trace_id: str = "trace") -> list[tuple]:
    """Rows of a message table from objects of any kind."""
    out = []
    for i, x in enumerate(items):
        m = ADAPTERS[name](x)
        out.append((trace_id, i, m.get("role") or "assistant", m.get("content") or "", m.get("tool_name"), m.get("tool_args")))
    return out


def register_pattern(kind: str, pattern: str, linking: bool = True) -> None:
    """Adds a kind of value; the pattern must do without look-around."""
    re.compile(pattern)
    T.PATTERNS[kind] = pattern
    if linking and kind not in T.LINKING:
        T.LINKING = (*T.LINKING, kind)


def use_tokenizer(encode: Callable[[str], list] | None) -> None:
    """Counts tokens by ``encode`` in all kernels planned from here on, wherever they run; None is the built-in (runs of blanks and non-blanks)."""
    D.ENCODE = encode


def tokenizer_from(path: str) -> Callable[[str], list]:
    """The encoder of a public tokenizer's vocabulary file (``tokenizer.json`` or a sentencepiece model)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path).encode
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model.encode
