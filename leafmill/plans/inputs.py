"""Inputs of queries that need jobs, glossaries, colours and the like: views of the given tables, with the literal rows before them.

A view is a table and an expression for each column, in words that Spark and DuckDB
share. It only makes the input; the rules are written apart for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import literals as L
from leafmill.sources.layout import table

View = tuple[str, L.Rows, list[str]]

SIX_DIGITS = "lpad(cast(p_partkey * 7919 % 1000000 AS string), 6, '0')"
JOBS: View = (
    "events",
    L.JOBS,
    [
        "event_id + 100",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'signup' THEN 'cancelling' ELSE 'done' END",
        "floor(value)",
        "concat('book ', user_id, '.pdf')",
        "props",
        "CASE WHEN event_id % 2 = 0 THEN 'flow' ELSE 'keep' END",
        "CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('/x/', event_id) END",
        "CASE WHEN event_type = 'error' THEN concat('GET /v1?key=k.', event_id, '-a&m=', user_id, ' failed') END",
        "CASE event_id % 3 WHEN 0 THEN concat('k', user_id) WHEN 1 THEN ' ' END",
        "CASE WHEN user_id % 5 > 0 THEN concat('s', user_id) END",
    ],
)
SUBMITS: View = ("events", L.SUBMITS, ["event_id + 100", "props", "CASE WHEN user_id % 2 = 0 THEN 'flow' ELSE 'keep' END"])
GLOSSARY: View = (
    "part",
    L.GLOSSARY,
    [
        "p_partkey + 100",
        "CASE WHEN p_size % 7 = 0 THEN 'x' ELSE concat(split_part(p_name, ' ', 1), ' ', p_size % 10) END",
        "CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 13 = 0 THEN concat(p_type, ',-', p_brand) ELSE concat(p_type, ' ', p_brand) END",
    ],
)
COLOURS: View = ("part", L.COLOURS, ["p_partkey + 100", "p_partkey * 7919 % 16777216", f"concat('#', {SIX_DIGITS})", "p_size % 32", "p_size / 3.0"])
SPANS: View = ("conversations", L.SPANS, ["conv_id + 100", "turn", "CASE WHEN role = 'system' THEN 1 ELSE 0 END", "text", "8 + length(text) % 7"])
MASK: View = ("events", L.MASK, ["user_id + 10", "floor(value)", "event_type <> 'error'"])
PIXELS: View = ("part", L.PIXELS, ["p_partkey % 40 + 10", "p_partkey % 256", "p_size * 5 % 256", "p_partkey * 31 % 256", "p_size"])
COVERS: View = (
    "part",
    L.COVERS,
    [
        "p_partkey + 100",
        f"""concat('Sure: [{{"text": "', p_name, '", "bbox_pct": [', p_size, ', ', p_size % 17, ', ', p_size * 3 % 130, ', ', p_size % 13, '], "color": "#', {SIX_DIGITS}, '", "role": "', CASE WHEN p_size % 2 = 0 THEN 'Title' ELSE 'logo' END, '"}}] end')""",
    ],
)


def _columns(view: View) -> list[str]:
    fields = [f.split(" ") for f in view[1][0].split(", ")]
    return [f"CAST({x} AS {kind}) AS {name}" for x, (name, kind) in zip(view[2], fields, strict=True)]


def frame(spark: SparkSession, folder: str, view: View) -> DataFrame:
    return L.frame(spark, view[1]).unionByName(table(spark, folder, view[0]).selectExpr(*_columns(view)))


def sql(view: View) -> str:
    return f"(SELECT * FROM {L.values(view[1])} UNION ALL SELECT {', '.join(_columns(view))} FROM {view[0]})"
