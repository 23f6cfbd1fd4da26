"""Rows as a table, CSV or JSON. A column's metadata may hold ``precision``, and ``header`` or ``skip`` for text output."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FORMATS = ("table", "json", "csv")
#: Decimal places of known columns in text output.
PRECISION = {
    "internal_ratio": 4, "expected": 2, "lift": 3, "text_expected": 2, "text_lift": 3, "pagerank": 6, "train_expected": 2, "test_expected": 2, "test_lift": 3,
    "hit_rate": 3, "evaluable_hit_rate": 3, "median_test_expected": 2, "median_test_lift": 3, "cost_usd": 3,
    **dict.fromkeys(("base_rate", "auroc", "auroc_stratified", "auroc_null", "excess", "delta", "delta_null", "p_value", "precision_at_k", "gap_precision_at_k"), 3),
}


def validate(schema: T.StructType) -> None:
    """Metadata that can't be meant: a precision of a column without decimals, or of one that is skipped."""
    for f in schema.fields:
        p = f.metadata.get("precision")
        if p is not None and (not isinstance(p, int) or p < 0):
            raise ValueError(f"{f.name}: precision must be a whole number")
        if p is not None and not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            raise ValueError(f"{f.name}: only floating-point columns have a precision")
        if f.metadata.get("skip") and (p is not None or "header" in f.metadata):
            raise ValueError(f"{f.name}: a skipped column has no other settings")
        if f.metadata.get("header") == "":
            raise ValueError(f"{f.name}: a header can't be empty")


def cell(value, precision: int | None = None) -> str:
    """A value as text; nothing for null. Half goes to the even digit of the exact value."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if precision is not None:
            return f"{value:.{precision}f}"
        return str(int(value)) if value.is_integer() and abs(value) < 1e16 else repr(value)
    return str(value)


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') else text


def table(headers: list[str], rows: list[list[str]]) -> str:
    """Left-aligned columns two spaces apart under a rule; short rows are filled up, long ones cut."""
    n = len(headers)
    rows = [(r + [""] * n)[:n] for r in rows]
    width = [max(len(x) for x in column) for column in zip(headers, *rows, strict=True)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width, strict=True)).rstrip()
    return "\n".join([line(headers), line(["-" * w for w in width]), *map(line, rows)]) + "\n"


def csv(headers: list[str], rows: list[list[str]]) -> str:
    n = len(headers)
    return "".join(",".join(map(_quoted, (r + [""] * n)[:n])) + "\n" for r in [headers, *rows])


def render(df: DataFrame, fmt: str = "table") -> str:
    """The rows of a result, which is a report: at most as many as were asked for come to the driver."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    validate(df.schema)
    fields = df.schema.fields
    records = [r.asDict(recursive=True) for r in df.collect()]
    if fmt == "json":
        return json.dumps([{f.name: r[f.name] for f in fields} for r in records], indent=2, ensure_ascii=False) + "\n"
    shown = [f for f in fields if not f.metadata.get("skip")]
    precise = lambda f: f.metadata.get("precision", PRECISION.get(f.name))
    rows = [[cell(r[f.name], precise(f)) for f in shown] for r in records]
    return (table if fmt == "table" else csv)([f.metadata.get("header", f.name) for f in shown], rows)
