"""The given tables read as tracks, cells, series, states, pixels and sheets. The same SQL serves Spark and the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_tracks_full": """
SELECT l_returnflag || l_linestatus AS experiment, l_suppkey AS parent,
  CAST(row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS INT) AS time_index,
  CAST(45.0 AS DOUBLE) AS dt, l_quantity * 20 AS x_pos, l_extendedprice / 100 AS y_pos,
  CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE l_quantity * (1 + l_tax) END AS area,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) / 1000 END AS intensity,
  CASE WHEN l_discount <= 0.03 THEN 'Neg' WHEN l_discount > 0.07 THEN 'High' ELSE 'Pos' END AS cha1_category,
  CASE WHEN l_tax <= 0.02 THEN 'Neg' WHEN l_tax > 0.06 THEN 'High' ELSE 'Pos' END AS cha2_category,
  (l_discount - 0.05) * 20 AS cha1_norm, l_orderkey, l_linenumber, l_partkey
FROM {lineitem}""",
    "v_tracks": "SELECT * FROM {v_tracks_full} WHERE time_index % 17 <> 0",
    "v_states": """
SELECT user_id AS parent, event_type AS cluster, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS time_index, value FROM {events}""",
    "v_series": "SELECT CAST(user_id AS STRING) AS unique_id, CAST(ts AS DATE) AS ds, sum(value) AS y FROM {events} GROUP BY 1, 2",
    "v_cells": """
SELECT experiment, parent, avg(area) AS area, avg(intensity) AS intensity, avg(x_pos) AS x_pos, avg(y_pos) AS y_pos, count(*) AS n_frames, CAST(parent % 3 AS INT) AS cluster
FROM {v_tracks} GROUP BY experiment, parent""",
    "v_a": "SELECT * FROM {v_cells} WHERE parent % 4 <> 0",
    "v_b": "SELECT experiment, parent, area + CASE WHEN parent % 5 = 0 THEN 0.25 ELSE 0 END AS area, intensity, x_pos, y_pos, n_frames, cluster FROM {v_cells} WHERE parent % 3 <> 0",
    "v_pixels": """
SELECT DISTINCT CAST(l_linenumber AS INT) AS frame, CAST(l_suppkey % 8 AS INT) AS label, CAST(l_quantity AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x,
  CAST(l_quantity + l_partkey % 7 AS DOUBLE) AS intensity FROM {lineitem}""",
    "v_long": """
SELECT experiment, parent, time_index, feature, value FROM (
  SELECT experiment, parent, time_index, 'area' AS feature, area AS value FROM {v_tracks} UNION ALL
  SELECT experiment, parent, time_index, 'intensity' AS feature, intensity AS value FROM {v_tracks}) q""",
    "v_sheets": """
SELECT sheet, value, unit, time, parent, id FROM (
  SELECT 'Area' AS sheet, area AS value, 'um^2' AS unit, time_index AS time, parent, l_orderkey * 10 + l_linenumber AS id FROM {v_tracks} UNION ALL
  SELECT 'Intensity' AS sheet, intensity AS value, '' AS unit, time_index AS time, parent, l_orderkey * 10 + l_linenumber AS id FROM {v_tracks} UNION ALL
  SELECT 'Position X' AS sheet, x_pos AS value, 'um' AS unit, time_index AS time, parent, l_orderkey * 10 + l_linenumber AS id FROM {v_tracks}) q""",
    "v_ids": """
SELECT s_suppkey AS parent, 'AM001100425CHR2' || chr(CAST(66 + s_suppkey % 4 AS INT)) || lpad(CAST(s_suppkey % 10 + 2 AS STRING), 2, '0') || '293T'
  || CASE s_suppkey % 2 WHEN 0 THEN 'METRNNIRNOCO' ELSE 'NNIRNOCO' END || 'NNN0WH00' AS experiment FROM {supplier}""",
}
#: Columns that a view reads from others: views in the text's braces, tables otherwise.
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def _needs(name: str) -> list[str]:
    return [x for x in [*VIEWS, *TABLES] if "{" + x + "}" in VIEWS[name]]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{x: frame(spark, sf_dir, x) for x in _needs(name)})


def with_views(sql: str, doubles: str = "", digits: int = 6, significant: bool = False) -> str:
    """SQL for the comparison: the views that it names go before it, and the named doubles are rounded."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in _needs(name):
            if x in VIEWS and x not in order:
                need(x)
        if name not in order:
            order.append(name)

    import re

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    body = ", ".join(f"{x} AS ({VIEWS[x].format(**{n: n for n in [*VIEWS, *TABLES]})})" for x in order)
    sql = sql.strip()
    if body:
        sql = f"WITH {body}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {body} {sql}"
    if doubles:
        scale = "power(10.0, floor(log10(nullif(abs(CAST({c} AS DOUBLE)), 0.0))))"
        cut = f"CASE WHEN {{c}} = 0 THEN 0.0 ELSE round(CAST({{c}} AS DOUBLE) / {scale}, {digits - 1}) * {scale} END AS {{c}}" if significant else f"round(CAST({{c}} AS DOUBLE), {digits}) + 0.0 AS {{c}}"
        sql = f"SELECT * REPLACE ({', '.join(cut.format(c=c) for c in doubles.split())}) FROM ({sql}) q"
    return sql
