"""Pruning of JSON payloads (an Arrow function: arbitrary nesting has no Column form)."""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that only describe a payload.
METADATA = (
    "_links", "_embedded", "_meta", "__typename", "$schema", "@odata.context", "@odata.type", "@odata.id", "@odata.etag",
    "@odata.nextLink", "@context", "@type", "@id", "_metadata", "_response", "_headers", "_status",
)


def number(x: int | float) -> str:
    """A number as scripts print it: that of the nearest double, with its shortest digits."""
    if isinstance(x, int) and abs(x) <= 1 << 53:
        return str(x)
    x = float(x)
    if x == 0 or x in (float("inf"), float("-inf")):
        return "0" if x == 0 else "null"
    sign, digits, exp = Decimal(repr(x)).normalize().as_tuple()
    d, point = "".join(map(str, digits)), len(digits) + exp  # the decimal point's place in the digits
    if 0 < point <= 21:
        text = d + "0" * (point - len(d)) if len(d) <= point else f"{d[:point]}.{d[point:]}"
    elif -6 < point <= 0:
        text = "0." + "0" * -point + d
    else:
        text = d[0] + (f".{d[1:]}" if d[1:] else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + text


def stringify(v) -> str:
    """Compact JSON; keys that are array indexes come first, by value."""
    if isinstance(v, dict):
        index = sorted((k for k in v if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < (1 << 32) - 1), key=int)
        return "{" + ",".join(f"{stringify(k)}:{stringify(v[k])}" for k in dict.fromkeys([*index, *v])) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(stringify, v)) + "]"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return number(v)
    return json.dumps(v, ensure_ascii=False)


def _constant(name: str):
    raise ValueError(name)  # NaN and the like aren't JSON


def prune(text: str | None, depth: int = 5, items: int = 5, nulls: bool = True, defaults: bool = False, fields: tuple = ()) -> dict:
    stats = {"fields_removed": 0, "arrays_truncated": 0, "depth_limited": 0, "nulls_removed": 0}
    try:
        value = json.loads(text or "", parse_constant=_constant)
    except (ValueError, RecursionError):
        return {"output": text, "valid": False, "nested": False, **stats}
    if isinstance(value, dict) and fields:
        stats["fields_removed"] += sum(k not in fields for k in value)
        value = {k: v for k, v in value.items() if k in fields}
    empty = lambda v: v is None or v in ("", [], {}) and v is not False

    def walk(v, d):
        if not isinstance(v, (dict, list)):
            return v
        if d > depth:
            stats["depth_limited"] += 1
            return "{...}" if isinstance(v, dict) else "[...]"
        if isinstance(v, list):
            out = []
            for x in v[:items]:
                if nulls and x is None:
                    stats["nulls_removed"] += 1
                else:
                    out.append(walk(x, d + 1))
            if len(v) > items:
                stats["arrays_truncated"] += 1
                out.append(f"... ({len(v) - items} more items)")
            return out
        out = {}
        for k, x in v.items():
            if k in METADATA:
                stats["fields_removed"] += 1
            elif nulls and empty(x):
                stats["nulls_removed"] += 1
            elif defaults and (x is False or x == "" or (x == 0 and not isinstance(x, bool))):
                stats["fields_removed"] += 1
            else:
                out[k] = walk(x, d + 1)
        return out

    return {"output": stringify(walk(value, 1)), "valid": True, "nested": isinstance(value, (dict, list)), **stats}


FIELDS = "output string, valid boolean, nested boolean, fields_removed int, arrays_truncated int, depth_limited int, nulls_removed int"


def prune_json(col: Column, **options) -> Column:
    @F.pandas_udf(FIELDS)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prune(x, **options) for x in s], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return run(col)
