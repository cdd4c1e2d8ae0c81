"""Queries on sheets, ids, layouts, manifests and crosswalks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.storage import new_folder
from trackloom.plans.registry import query
from trackloom.sources import io

K = ["experiment", "parent"]


@query("v_tracks", sql="SELECT experiment, parent, time_index, area, intensity FROM v_tracks", doubles="area intensity", digits=9)
def scan_tracks(df: DataFrame) -> DataFrame:
    return df.select(*K, "time_index", "area", "intensity")


@query("v_a", "v_b", sql="SELECT experiment, parent, area, n_frames FROM v_a UNION ALL SELECT experiment, parent, area, NULL FROM v_b", doubles="area")
def union_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*K, "area", "n_frames").unionByName(b.select(*K, "area"), allowMissingColumns=True)


@query("supplier", sql="SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'known' ELSE 'supplier' END AS experiment FROM supplier")
def source_name_column(supplier: DataFrame) -> DataFrame:
    named = io.source_name_column(supplier.withColumn("experiment", F.when(F.col("s_suppkey") % 2 == 0, "known")), "experiment")
    return named.select("s_suppkey", "experiment")


@query("v_a", "v_b", sql="SELECT experiment, count(*) AS n, count(n_frames) AS n_known FROM (SELECT experiment, n_frames FROM v_a UNION ALL SELECT experiment, NULL FROM v_b) GROUP BY experiment")
def merge_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    merged = a.select(*K, "n_frames").unionByName(b.select(*K), allowMissingColumns=True)
    return merged.groupBy("experiment").agg(F.count("*").alias("n"), F.count("n_frames").alias("n_known"))


@query("v_sheets", sql="""
SELECT id, parent, time, min(value) FILTER (WHERE sheet = 'Area') AS area, min(value) FILTER (WHERE sheet = 'Intensity') AS intensity, min(value) FILTER (WHERE sheet = 'Position X') AS position_x FROM v_sheets GROUP BY ALL""", doubles="area intensity position_x", digits=9)
def sheets_to_wide(sheets: DataFrame) -> DataFrame:
    return io.sheets_to_wide(sheets, ["Area", "Intensity", "Position X"])


@query("v_sheets", sql="""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY sheet, parent, time ORDER BY id, value NULLS FIRST) AS o FROM v_sheets), k AS (SELECT parent, time, o, min(CASE WHEN sheet <> 'Area' THEN 1 ELSE 0 END) AS late FROM p GROUP BY ALL),
n AS (SELECT parent, time, o, row_number() OVER (ORDER BY late, parent, time, o) AS new_id FROM k) SELECT sheet, p.parent, p.time, CAST(new_id AS BIGINT) AS new_id, count(*) AS n FROM p JOIN n USING (parent, time, o) GROUP BY ALL""")
def repair_duplicate_ids(sheets: DataFrame) -> DataFrame:
    return io.repair_duplicate_ids(sheets, "Area").groupBy("sheet", "parent", "time", "new_id").agg(F.count("*").alias("n"))


@query("v_ids", sql="SELECT parent, CASE WHEN parent % 3 = 0 THEN 'full ' || substr(experiment, 16, 3) ELSE substr(experiment, 16, 3) END AS well FROM v_ids")
def well_map(ids: DataFrame) -> DataFrame:
    own = F.when(F.col("parent") % 3 == 0, F.concat(F.lit("x"), F.substring("experiment", 16, 3))).otherwise(F.substring("experiment", 16, 3))
    wells = ids.select("parent", own.alias("well"))
    names = ids.where("parent % 3 = 0").select(F.concat(F.lit("x"), F.substring("experiment", 16, 3)).alias("short"), F.concat(F.lit("full "), F.substring("experiment", 16, 3)).alias("full"))
    return io.well_map(wells, names, "well")


@query("v_tracks", sql="""
SELECT 'area' AS sheet, 0 AS sheet_order, area AS value, 'um^2' AS unit, 'Surface' AS category, time_index AS time, parent, l_orderkey AS id FROM v_tracks WHERE area IS NOT NULL UNION ALL SELECT 'x_pos', 1, x_pos, 'um', 'Surface', time_index, parent, l_orderkey FROM v_tracks""", doubles="value")
def wide_to_sheets(df: DataFrame) -> DataFrame:
    return io.wide_to_sheets(df, ["area", "x_pos"], "l_orderkey")


@query("v_tracks", sql="SELECT experiment, parent, time_index, area AS size, sqrt(power(x_pos, 2) + power(y_pos, 2)) AS radius, CASE WHEN area > 30 THEN least(greatest(-area + 50, 5), 10) ELSE 1.5 END AS odd, CASE WHEN x_pos <> 0 THEN sqrt(y_pos / x_pos % 3) END AS rest FROM v_tracks", doubles="size radius odd rest", digits=9)
def crosswalk_project(df: DataFrame) -> DataFrame:
    targets = [
        io.Target("size", source="AREA"), io.Target("radius", formula='sqrt(COL("x_pos") ** 2 + `y_pos`**2)'), io.Target("odd", formula="where(area > 30, clip(-area + 50, 5, 10), 1.5)"),
        io.Target("rest", formula="sqrt(y_pos / x_pos % 3)"), io.Target("gone", source="volume"),
    ]
    return io.crosswalk_project(df, targets, [*K, "time_index"])[0]


@query("v_tracks", sql="""
SELECT experiment, parent, time_index, sqrt(x_pos * x_pos + y_pos * y_pos) AS radius, CASE WHEN intensity > 30 THEN CASE WHEN area IS NOT NULL THEN least(greatest(intensity - area, -5), 20) END ELSE -abs(x_pos - y_pos) END AS bounded,
  ln(area + 1) + exp(-intensity / 10) - power(x_pos, 1.5) % 7 AS mixed FROM v_tracks""", doubles="radius bounded mixed")
def formula_project(df: DataFrame) -> DataFrame:
    of = lambda text: io.formula(text, df.columns)
    return df.select(
        *K, "time_index", of('sqrt(COL("x_pos") ** 2 + `Y_POS` ** 2)').alias("radius"), of("where(intensity > 30, clip(intensity - area, -5, 20), -abs(x_pos - y_pos))").alias("bounded"),
        of("log(area + 1) + exp(-intensity / 10) - x_pos ** 1.5 % 7").alias("mixed"),
    )


@query("v_tracks", sql="SELECT * FROM (VALUES ('a', 'copied'), ('b', 'missing volume'), ('c', 'formula'), ('d', 'not understood')) v(target, status)")
def crosswalk_status(df: DataFrame) -> DataFrame:
    return io.crosswalk_project(df, [io.Target("a", source="area"), io.Target("b", source="volume"), io.Target("c", formula="area * 2"), io.Target("d", formula="area * (2")])[1]


@query("v_tracks", sql="SELECT true AS two_d, 45.0 AS dt, CAST(0 AS BIGINT) AS n_other", doubles="dt")
def infer_run_params(df: DataFrame) -> DataFrame:
    timed = df.withColumns({"seconds": F.col("time_index") * F.col("dt") * 60, "z": F.col("parent") % 4 + 0.001})
    return io.infer_run_params(timed, K, "time_index", "seconds", "z")


def _paths(supplier: DataFrame) -> DataFrame:
    day = F.col("s_suppkey") * 7 % 97
    stamp = F.concat(F.lit("2024y"), F.lpad((day % 12 + 1).cast("string"), 2, "0"), F.lit("m"), F.lpad((day % 28 + 1).cast("string"), 2, "0"), F.lit("d_"), F.lpad((day % 24).cast("string"), 2, "0"), F.lit("h15m"))
    channel = F.when(F.col("s_suppkey") % 2 == 0, "red").otherwise("phase")
    return supplier.select(F.concat(F.lit("/data/run_A"), (F.col("s_suppkey") % 3).cast("string"), F.lit("_"), channel, F.lit("_"), stamp, F.lit("_"), F.col("s_suppkey").cast("string"), F.lit(".tif")).alias("path"))


_MANIFEST = """
WITH p AS (SELECT 'A' || (s_suppkey % 3) AS field, CASE s_suppkey % 2 WHEN 0 THEN 'red' ELSE 'phase' END AS channel, s_suppkey * 7 % 97 AS d, s_suppkey FROM supplier),
q AS (SELECT field, channel, '2024y' || lpad(CAST(d % 12 + 1 AS VARCHAR), 2, '0') || 'm' || lpad(CAST(d % 28 + 1 AS VARCHAR), 2, '0') || 'd_' || lpad(CAST(d % 24 AS VARCHAR), 2, '0') || 'h15m' AS t, s_suppkey FROM p),
r AS (SELECT '/data/run_' || field || '_' || channel || '_' || t || '_' || s_suppkey || '.tif' AS path, field, channel, CAST(regexp_replace(t, '\\D', '', 'g') AS BIGINT) AS stamp FROM q),
m AS (SELECT *, CAST(row_number() OVER (PARTITION BY field, channel ORDER BY stamp, path) - 1 AS INT) AS frame FROM r)
SELECT *, field || '_' || channel || '_t' || lpad(CAST(frame AS VARCHAR), 4, '0') AS target FROM m"""


@query("supplier", sql=_MANIFEST)
def manifest(supplier: DataFrame) -> DataFrame:
    return io.manifest(_paths(supplier))


@query("supplier", sql=f"SELECT path, frame FROM ({_MANIFEST}) WHERE field = 'A1' AND channel = 'red' OR field = 'A2' AND channel = 'phase'")
def manifest_select(supplier: DataFrame) -> DataFrame:
    return io.manifest_select(io.manifest(_paths(supplier)), ["a01_RED", "A2|phase"]).select("path", "frame")


@query("v_ids", sql="""
SELECT parent, substr(experiment, 16, 3) AS well, CASE substr(experiment, 16, 1) WHEN 'B' THEN CASE WHEN CAST(substr(experiment, 17, 2) AS INT) <= 5 THEN 'METR&GABY' END WHEN 'C' THEN CASE CAST(substr(experiment, 17, 2) AS INT) WHEN 3 THEN 'CON' END END AS treatments FROM v_ids""")
def plate_layout(ids: DataFrame) -> DataFrame:
    layout = {"B": {c: ["METR", "GABY"] for c in range(2, 6)}, "C": {3: ["", "CON"]}}
    return io.plate_layout(ids.select("parent", F.substring("experiment", 16, 3).alias("well")), layout).select("parent", "well", "treatments")


@query("v_tracks", sql="SELECT experiment, parent, time_index, l_orderkey, area FROM v_tracks", doubles="area", digits=9)
def write_tracks(df: DataFrame) -> DataFrame:
    """Written as a stored table, written again (which changes nothing), and read back."""
    rows, path = df.select(*K, "time_index", "l_orderkey", "area"), new_folder(df, "tracks")
    if not io.write_tracks(rows, path, "experiment") or io.write_tracks(rows, path, "experiment", "overwrite"):
        raise ValueError("a first write must write, and a repeated one must not")
    return io.read_tracks(df.sparkSession, path)


@query("embeddings", sql="""
SELECT vec_id, CASE WHEN vec_id % 7 > 0 THEN 'e' || label END AS experiment, CASE WHEN vec_id % 7 > 0 THEN CAST(vec_id AS VARCHAR) END AS parent, CASE WHEN vec_id % 7 > 0 THEN len(embedding) END AS n_values,
  CASE WHEN vec_id % 7 > 0 THEN list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) END AS total, CASE WHEN vec_id % 7 > 0 THEN CAST(label AS DOUBLE) END AS label, vec_id % 7 = 0 AS corrupt FROM embeddings""", doubles="total label", digits=5)
def embedding_records(embeddings: DataFrame) -> DataFrame:
    """Rows written as JSON lines, some of them broken, and read back."""
    vectors = F.create_map(F.lit("vector"), F.col("embedding").cast("array<double>"), F.lit("label"), F.array(F.col("label").cast("double")))
    rows = embeddings.select("vec_id", F.concat(F.lit("e"), F.col("label")).alias("experiment"), F.col("vec_id").alias("parent"), vectors.alias("vectors"))
    made = io.record_lines(rows, K, keep=["vec_id"])
    broken = F.when(F.col("vec_id") % 14 == 0, F.expr("left(value, length(value) - 3)")).when(F.col("vec_id") % 7 == 0, F.replace(F.col("value"), F.lit('"vector":['), F.lit('"vector":["x",'))).otherwise(F.col("value"))
    read = io.parse_records(made.withColumn("value", broken), K)
    total = F.aggregate(F.element_at("vectors", F.lit("vector")), F.lit(0.0), lambda a, x: a + x)
    return read.select("vec_id", *K, F.size(F.element_at("vectors", F.lit("vector"))).cast("long").alias("n_values"), total.alias("total"), F.get(F.element_at("vectors", F.lit("label")), F.lit(0)).alias("label"), F.col("corrupt").isNotNull().alias("corrupt"))
