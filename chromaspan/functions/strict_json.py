"""Bounded, strict JSON: no repeated keys, no NaN or infinities, no lone surrogates, bounded depth."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


class StrictJsonError(ValueError):
    pass


def loads(text: str, max_bytes: int = 16 << 20, max_depth: int = 64, max_digits: int = 128) -> object:
    if len(text.encode("utf-8", "surrogatepass")) > max_bytes:
        raise StrictJsonError("too long")
    depth, quoted, escaped = 0, False, False
    for c in text:
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            if depth > max_depth:
                raise StrictJsonError("too deep")
        elif c in "]}":
            depth -= 1

    def unique(pairs: list) -> dict:
        found = dict(pairs)
        if len(found) != len(pairs):
            raise StrictJsonError("repeated key")
        return found

    def whole(x: str) -> int:
        if len(x.lstrip("-")) > max_digits:
            raise StrictJsonError("integer too long")
        return int(x)

    def finite(x: str) -> float:
        if (got := float(x)) in (float("inf"), float("-inf")):
            raise StrictJsonError("number out of range")
        return got

    def refuse(x: str) -> None:
        raise StrictJsonError(f"{x} isn't JSON")

    try:
        value = json.loads(text, object_pairs_hook=unique, parse_int=whole, parse_float=finite, parse_constant=refuse)
    except (json.JSONDecodeError, RecursionError) as e:
        raise StrictJsonError(str(e)) from None
    waiting = [value]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str) and any("\ud800" <= c <= "\udfff" for c in x):
            raise StrictJsonError("surrogate")
        if isinstance(x, dict):
            waiting += [*x.keys(), *x.values()]
        elif isinstance(x, list):
            waiting += x
    return value


def _ok(text: str | None) -> bool:
    try:
        loads(text or "")
    except StrictJsonError:
        return False
    return True


@F.pandas_udf(BooleanType())
def is_strict(texts: pd.Series) -> pd.Series:
    return texts.map(_ok)
