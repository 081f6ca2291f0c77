"""Canonical JSON of texts of any shape: keys in code-point order at every depth, no white space, UTF-8.

The built-in variant type sorts keys too, but loses what a number looked like (1.0), takes keys in UTF-16 order and
refuses repeated keys; so this is an Arrow function over batches with the standard JSON reader.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

QUOTED = json.JSONEncoder(ensure_ascii=False).encode


def number(value: float) -> str:
    """A float as the contract writes it: a point before any exponent."""
    said = repr(value)
    return said.replace("e", ".0e", 1) if "e" in said and "." not in said else said


def dumped(value: object) -> str:
    """JSON of a value, from its leaves up; a stack instead of calls, so that depth has no limit."""
    done: list[str] = []
    waiting: list[tuple[bool, object]] = [(False, value)]
    while waiting:
        made, one = waiting.pop()
        if isinstance(one, dict):
            keys = sorted(one)
            if made:
                parts = done[len(done) - len(keys) :]
                del done[len(done) - len(keys) :]
                done.append("{" + ",".join(f"{QUOTED(k)}:{p}" for k, p in zip(keys, parts, strict=True)) + "}")
            else:
                waiting += [(True, one), *[(False, one[k]) for k in reversed(keys)]]
        elif isinstance(one, list):
            if made:
                parts = done[len(done) - len(one) :]
                del done[len(done) - len(one) :]
                done.append("[" + ",".join(parts) + "]")
            else:
                waiting += [(True, one), *[(False, x) for x in reversed(one)]]
        else:
            done.append(number(one) if isinstance(one, float) else QUOTED(one))
    return done[0]


def refused(name: str) -> None:
    raise ValueError(name)


def finite(text: str) -> float:
    value = float(text)
    return value if value - value == 0 else refused(text)


def canonical_text(text: str | None) -> str | None:
    """Null for what is no JSON, and for numbers that are too large for a float."""
    if text is None:
        return None
    try:
        made = dumped(json.loads(text, parse_constant=refused, parse_float=finite))
        made.encode()
    except (ValueError, RecursionError):
        return None
    return made


def canonical_json_text(text: Column) -> Column:
    """The canonical form of JSON texts of any shape, null for what is none."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([canonical_text(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())(text)


def item_hash(text: Column) -> Column:
    """SHA-256 of a whole item as canonical JSON: the content hash of records that come as API items."""
    return F.sha2(canonical_json_text(text), 256)
