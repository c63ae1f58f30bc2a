"""Payload templates: what a payload says with its changing values masked.

Text goes through NFKC, percent-decoding and ordered masks; JSON is walked key by key. Neither Unicode
normal forms nor recursion over JSON have a built-in form, so these run as Arrow UDFs over batches.
`masked_native` is the built-in path for text that is already plain ASCII.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache, lru_cache, partial, reduce
from typing import Any
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions import markers as M

VALUE_CHARS = 4096
#: Masked texts that a worker remembers, and their length at most.
REMEMBERED, REMEMBERED_CHARS = 50_000, 256
TEMPLATE_CHARS = 16384
_EMPTY = (None, "", [], {})


_dump: Callable[[Any], str] = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def value_masks(digits: int | None = 6) -> list[tuple[str, str]]:
    """The masks of a text's values and their patterns, in the order in which every form of masking applies them."""
    number = [] if digits is None else [("<NUMBER>", rf"(?<![\w.])\d{{{digits},}}(?![\w.])")]
    return [*M.MASKS, *number, ("<TOKEN>", M.ENCODED_TOKEN)]


@cache
def key_mask(key: str) -> str | None:
    """As text.key_placeholder, for keys inside JSON and query strings."""
    return next((mask for mask, pattern in M.KEY_RULES if re.fullmatch(pattern, key.casefold())), None)


def _with_query_masks(text: str) -> str:
    pieces, at = [], 0
    for found in re.finditer(M.QUERY_VALUE, text):
        mask = key_mask(found[2])
        if mask:
            pieces += text[at : found.start(3)], mask
            at = found.end()
    return "".join([*pieces, text[at:]])


@cache
def _stages(digits: int | None) -> tuple[Callable[[str], str], ...]:
    """What masking does to a text in normal form, step by step."""
    escaped = re.compile("%[0-9a-fA-F]{2}")
    masks = [partial(re.compile(pattern).sub, mask) for mask, pattern in value_masks(digits)]
    return (lambda t: unquote_plus(t) if escaped.search(t) else t, lambda t: " ".join(t.split()), _with_query_masks, *masks)


def plain_text(text: str, limit: int = VALUE_CHARS) -> str:
    return " ".join(unicodedata.normalize("NFKC", text[:limit]).split())


def mask_text(text: str, limit: int = VALUE_CHARS, digits: int | None = 6) -> str:
    """Values of payloads recur, so short ones are masked once a worker."""
    return (_mask_once if len(text) <= REMEMBERED_CHARS else _mask)(text, limit, digits)


def _mask(text: str, limit: int, digits: int | None) -> str:
    return reduce(lambda t, stage: stage(t), _stages(digits), unicodedata.normalize("NFKC", text[:limit]))


_mask_once = lru_cache(REMEMBERED)(_mask)


def walk(value: Any, on_text: Callable[[str], str], mask_keys: bool, key: str | None = None) -> Any:
    """A JSON value with on_text applied to its texts, empty members gone and, with mask_keys, values
    replaced whose key tells what they are."""
    if mask_keys and key is not None and value not in _EMPTY and key_mask(key):
        return key_mask(key)
    if isinstance(value, dict):
        return {k: walk(v, on_text, mask_keys, k) for k, v in sorted(value.items()) if v not in _EMPTY}
    if isinstance(value, list):
        return [walk(v, on_text, mask_keys, key) for v in value]
    return on_text(value) if isinstance(value, str) else value


def payload_of(attributes: dict) -> Any:
    if "payload_fields" in attributes:
        return attributes["payload_fields"]
    return {k: attributes[k] for k in M.PAYLOAD_KEYS if k in attributes} or None


def template(attributes: str | None, generalize: bool, digits: int | None = 6) -> str:
    payload = payload_of(json.loads(attributes) if attributes else {})
    if payload in _EMPTY:
        return ""
    on_text = (lambda t: mask_text(t, VALUE_CHARS, digits)) if generalize else plain_text
    out = _dump(walk(payload, on_text, generalize))
    if len(out) <= TEMPLATE_CHARS:
        return out
    digest = hashlib.sha256(out.encode()).hexdigest()
    return _dump({"template_prefix": out[: TEMPLATE_CHARS - 128], "template_sha256": digest, "truncated": True})


def payload_template(attributes: Column, generalize: bool, digits: int | None = 6) -> Column:
    """Template of an attributes JSON text: exact values, or masked ones with generalize. Equal texts of a batch are read once."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        made = {t: template(t, generalize, digits) for t in set(texts)}
        return texts.map(made.get)

    return run(attributes)


def masked(text: Column, digits: int | None = 6) -> Column:
    """Text with its changing values masked."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask_text(t, VALUE_CHARS, digits))

    return run(text)


def masked_native(text: Column, digits: int | None = 6) -> Column:
    """The same masks as built-in expressions, for text without percent escapes, query values of masked
    keys and compatibility characters."""
    out = F.trim(F.regexp_replace(F.substring(text, 1, VALUE_CHARS), r"(?U)\s+", " "))
    for name, pattern in value_masks(digits):
        out = F.regexp_replace(out, f"(?U){pattern}", name)
    return out
