"""Track tables in and out: readers with explicit schemas, sheets, manifests of image files, layouts and crosswalks."""

from __future__ import annotations

import ast
import json
import operator
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.columns import finite
from trackloom.operators import order

#: Fixed: the key columns of a track table and their types; every other column is a feature.
TRACK_KEYS = {"Experiment": T.StringType(), "Parent": T.StringType(), "TimeIndex": T.IntegerType(), "dt": T.DoubleType(), "ID": T.LongType()}
#: Fixed: columns that earlier exports left behind.
LEGACY = ("Unnamed: 0", "index", "level_0")


def scan_tracks(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A track table from Parquet or CSV (by extension), keys typed and features as finite doubles.

    A CSV without schema has its header read for the names only: nothing is inferred from the data.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if paths[0].split("?")[0].rstrip("/").endswith((".csv", ".csv.gz", ".txt")):
        reader = spark.read.option("header", True).option("encoding", encoding)
        raw = (reader.schema(schema) if schema else reader).csv(paths)
    else:
        raw = spark.read.parquet(*paths)
    raw = raw.drop(*LEGACY)
    typed = {c: F.col(f"`{c}`").try_cast(TRACK_KEYS[c]) if c in TRACK_KEYS else finite(F.col(f"`{c}`").try_cast("double")) for c in raw.columns if c in TRACK_KEYS or not isinstance(raw.schema[c].dataType, T.TimestampType)}
    strings = {c for c in raw.columns if c not in TRACK_KEYS and (c.endswith("_Category") or c in ("Treatment", "unique_id"))}
    return raw.select([F.col(f"`{c}`") if c in strings or c not in typed else typed[c].alias(c) for c in raw.columns])


def features(df: DataFrame) -> list[str]:
    """Numeric columns that are no keys."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in TRACK_KEYS]


def union_runs(spark: SparkSession, paths: Sequence[str], full: bool | None = None) -> DataFrame:
    """Runs one after the other; columns that a run lacks are null. full: only files with FULL in their name, or only those without."""
    chosen = [p for p in paths if full is None or ("FULL" in p.rsplit("/", 1)[-1]) == full]
    if not chosen:
        raise ValueError("no file is left")
    out = scan_tracks(spark, chosen[0])
    for p in chosen[1:]:
        out = out.unionByName(scan_tracks(spark, p), allowMissingColumns=True)
    return out


def source_name_column(df: DataFrame, column: str = "Experiment", pattern: str = r"([^/]+?)(?:_summary)?\.\w+$") -> DataFrame:
    """The experiment's name from the file's, where it is missing. For frames read from files."""
    name = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.select("*", F.coalesce(F.col(column), name).alias("__c") if column in df.columns else name.alias("__c")).drop(column).withColumnRenamed("__c", column)


def well_map(df: DataFrame, names: DataFrame, column: str, most: int = 100_000) -> DataFrame:
    """Short names replaced by full ids (names: short, full); others stay. The map is broadcast up to `most` names, joined beyond."""
    unique = names.groupBy("short").agg(F.min("full").alias("full"))
    small = unique.limit(most + 1).count() <= most
    joined = df.join(F.broadcast(unique) if small else unique, F.col(column) == F.col("short"), "left")
    return joined.withColumn(column, F.coalesce("full", column)).drop("short", "full")


# ---- stored tables -----------------------------------------------------------------------------------------------------------
#
# A stored table is a folder of versions, each written once, and a folder of numbered manifests. The table is what its last manifest names: a
# version is there as a whole or not at all, and of two writers of the same number one fails.

#: Bytes that a file of a stored table should have, before compression.
FILE_BYTES = 256_000_000
#: Bytes of a value, and of one of any other type.
WIDTHS, LOOSE = {"double": 8, "long": 8, "integer": 4, "float": 4, "boolean": 1, "date": 4, "timestamp": 8}, 32


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function from names to its paths."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda *names: p("/".join([path, *names]))


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The number of the last manifest (0: none) and what it says."""
    fs, at = _files(spark, path)
    if not fs.exists(at("manifests")):
        return 0, None
    names = sorted(x.getPath().getName() for x in fs.listStatus(at("manifests")))
    if not names:
        return 0, None
    stream = fs.open(at("manifests", names[-1]))
    try:
        return int(names[-1].split(".")[0]), json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _contents(df: DataFrame) -> dict:
    """What tells tables apart: number of rows and a sum of their hashes, whatever their order."""
    columns = sorted(df.columns)
    row = df.select(F.count("*").alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")).alias("hash")).first()
    return {"rows": row["rows"], "hash": str(row["hash"]), "columns": [f"{c} {df.schema[c].dataType.simpleString()}" for c in columns]}


def write_tracks(df: DataFrame, path: str, by: str = "Experiment", mode: str = "errorifexists", file_bytes: int = FILE_BYTES) -> bool:
    """df as a stored table with a folder for each value of `by`, in as many files as its rows ask for. False: the table holds these rows already, and nothing is written.

    mode: errorifexists, or overwrite, which adds a version and makes it the table. A writer that is lost leaves a version that no manifest names.
    An empty string in `by` is read back as null, as it has no folder of its own.
    """
    spark = df.sparkSession
    number, last = _manifest(spark, path)
    contents = _contents(df)
    if last is not None and {k: last[k] for k in contents} == contents and last["by"] == by:
        return False
    if last is not None and mode != "overwrite":
        raise ValueError(f"{path} holds another table")
    width = sum(WIDTHS.get(f.dataType.typeName(), LOOSE) for f in df.schema)
    sizes = df.groupBy(by).agg(F.ceil(F.count("*") * width / file_bytes).alias("__files"))
    spread = order.beside(df, sizes if sizes.limit(100_001).count() > 100_000 else F.broadcast(sizes), [by])
    version = uuid.uuid4().hex
    rows = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != by])
    spread.withColumn("__file", F.pmod(rows, F.col("__files"))).repartition(by, "__file").drop("__file", "__files").write.option("maxRecordsPerFile", max(1, file_bytes // width)).partitionBy(by).parquet(f"{path}/versions/{version}")
    fs, at = _files(spark, path)
    stream = fs.create(at("manifests", f"{number + 1:012d}.json"), False)  # fails if another writer was first
    try:
        stream.write(bytearray(json.dumps({**contents, "by": by, "type": df.schema[by].dataType.simpleString(), "version": version}).encode()))
    finally:
        stream.close()
    return True


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A stored table as its last manifest names it."""
    _, last = _manifest(spark, path)
    if last is None:
        raise ValueError(f"no table is stored in {path}")
    kinds = dict(c.rsplit(" ", 1) for c in last["columns"])
    df = spark.read.schema(", ".join(f"`{c}` {t}" for c, t in kinds.items())).parquet(f"{path}/versions/{last['version']}")
    return df.withColumn(last["by"], F.col(last["by"]).cast(last["type"]))


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Versions that the last manifest does not name go, those of lost writers too; how many there were. Not for use while others read or write."""
    _, last = _manifest(spark, path)
    fs, at = _files(spark, path)
    old = [x.getPath() for x in fs.listStatus(at("versions")) if last is None or x.getPath().getName() != last["version"]]
    for p in old:
        fs.delete(p, True)
    return len(old)


# ---- records -----------------------------------------------------------------------------------------------------------------


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def record_lines(df: DataFrame, keys: Sequence[str] = ("Experiment", "Parent"), vectors: str = "vectors", keep: Sequence[str] = ()) -> DataFrame:
    """value (beside the columns `keep`): one JSON object for each row, of its keys and of the lists in a map column, side by side as in an embedding file."""
    head, body = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), F.to_json(F.coalesce(vectors, F.create_map().cast("map<string,array<double>>")))
    return df.select(*keep, F.when(body == "{}", head).otherwise(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substr(body, F.lit(2)))).alias("value"))


def parse_records(lines: DataFrame, keys: Sequence[str] = ("Experiment", "Parent"), line: str = "value") -> DataFrame:
    """lines with their keys (strings), vectors (map of name to list of doubles) and corrupt: the line itself where it is no object, lacks a key or holds anything but lists of numbers beside the keys.

    A corrupt line has null keys and vectors. Blank lines go.
    """
    parsed = lines.where(F.col(line).isNotNull() & (F.trim(line) != "")).withColumn("__m", F.from_json(line, "map<string,string>"))
    named = F.array(*[F.lit(k) for k in keys])
    lists = F.transform_values(F.map_filter("__m", lambda k, v: ~F.array_contains(named, k)), lambda k, v: F.from_json(v, "array<double>"))
    read = parsed.withColumn("__v", lists)
    whole = F.coalesce(F.forall(F.map_values("__v"), lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull())) & F.forall(named, lambda k: F.element_at("__m", k).isNotNull()), F.lit(False))
    rest = [c for c in lines.columns if c != line]
    return read.select(*rest, *[F.when(whole, F.element_at("__m", F.lit(k))).alias(k) for k in keys], F.when(whole, F.col("__v")).alias("vectors"), F.when(~whole, F.col(line)).alias("corrupt"))


def read_records(spark: SparkSession, path: str | Sequence[str], keys: Sequence[str] = ("Experiment", "Parent"), array: bool = False) -> DataFrame:
    """parse_records of files with one object in each line; array: of files that hold one list of objects each (read whole, a file by a task)."""
    if not array:
        return parse_records(spark.read.text(path), keys)
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    return parse_records(whole, keys)


# ---- sheets ------------------------------------------------------------------------------------------------------------------


def normalised(name: str) -> str:
    """A sheet's name as a column's: words joined by _, without marks."""
    return re.sub(r"\W+", "_", name).strip("_").lower()


def sheets_to_wide(sheets: DataFrame, names: Sequence[str], key: Sequence[str] = ("id", "parent", "time")) -> DataFrame:
    """One row for each object with a column for each named sheet; the smallest of several values."""
    wide = sheets.where(F.col("sheet").isin(*names)).groupBy(*key).pivot("sheet", list(names)).agg(F.min("value"))
    return wide.select(*key, *[F.col(f"`{n}`").alias(normalised(n)) for n in names])


#: Fixed: units of the measurements that are exported.
UNITS = {"area": "um^2", "intensity": "", "x_pos": "um", "y_pos": "um", "speed": "um/h", "displacement2": "um^2"}


def wide_to_sheets(df: DataFrame, measures: Sequence[str], id_column: str = "id", parent: str = "parent", time: str = "time_index", category: str = "Surface") -> DataFrame:
    """The long layout: sheet, value, unit, category, time, parent, id, with the sheets in the given order (sheet_order)."""
    rows = F.array(*[F.struct(F.lit(m).alias("sheet"), F.lit(i).alias("sheet_order"), F.col(m).cast("double").alias("value"), F.lit(UNITS.get(m, "")).alias("unit")) for i, m in enumerate(measures)])
    out = df.select(F.col(time).alias("time"), F.col(parent).alias("parent"), F.col(id_column).alias("id"), F.lit(category).alias("category"), F.explode(rows).alias("r"))
    return out.select("r.sheet", "r.sheet_order", "r.value", "r.unit", "category", "time", "parent", "id").where(F.col("value").isNotNull())


def repair_duplicate_ids(sheets: DataFrame, reference: str) -> DataFrame:
    """sheets with new_id: where ids repeat within a sheet, objects are numbered by (parent, time, occurrence), alike in all sheets.

    Keys of the reference sheet are numbered first, keys that only others have come after.
    """
    line = Window.partitionBy("sheet", "parent", "time").orderBy("id", "value")
    placed = sheets.withColumn("occurrence", F.row_number().over(line))
    keys = placed.groupBy("parent", "time", "occurrence").agg(F.min((F.col("sheet") != reference).cast("int")).alias("late"))
    # numbers that are dense over all keys: counts before each (late, parent), then places within
    per = keys.groupBy("late", "parent").agg(F.count("*").alias("n"))
    before = order.cumulative(per, [], ["late", "parent"], n="n").select("late", "parent", F.col("n_before").alias("before"))
    within = F.row_number().over(Window.partitionBy("late", "parent").orderBy("time", "occurrence"))
    numbered = keys.withColumn("place", within).join(before, ["late", "parent"]).select("parent", "time", "occurrence", (F.col("before") + F.col("place")).alias("new_id"))
    return placed.join(numbered, ["parent", "time", "occurrence"]).drop("occurrence")


def infer_run_params(df: DataFrame, key: Sequence[str], time: str, seconds: str, z: str | None = None) -> DataFrame:
    """two_d (fewer than six different rounded z), dt (the first track's duration over its frames, minutes) and how many tracks differ from it."""
    tracks = df.groupBy(*key).agg((F.max(seconds) - F.min(seconds)).alias("d"), (F.max(time) - F.min(time)).alias("f")).where("f > 0")
    dt = tracks.select(*key, (F.col("d") / F.col("f") / 60).alias("dt"))
    first = dt.agg(F.min_by("dt", F.struct(*key)).alias("dt"))
    flat = df.agg((F.countDistinct(F.round(z, 2)) < 6).alias("two_d")) if z else df.sparkSession.range(1).select(F.lit(True).alias("two_d"))
    others = dt.crossJoin(F.broadcast(first.withColumnRenamed("dt", "dt0"))).agg(F.count_if(F.abs(F.col("dt") - F.col("dt0")) > 1e-6).alias("n_other"))
    return flat.crossJoin(first).crossJoin(others)  # three single rows


# ---- crosswalk ---------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Target:
    """A column to make: a source column, or a formula over columns."""

    name: str
    source: str | None = None
    formula: str | None = None


_BINARY = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Pow: F.pow, ast.Div: lambda a, b: a / F.nullif(b, F.lit(0.0)), ast.Mod: lambda a, b: a % F.nullif(b, F.lit(0.0)),
    ast.Lt: operator.lt, ast.Gt: operator.gt, ast.LtE: operator.le, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne,
}
_FUNCTIONS = {"sqrt": F.sqrt, "log": F.ln, "exp": F.exp, "abs": F.abs, "clip": lambda x, low, high: F.when(x.isNotNull(), F.greatest(F.least(x, high), low)), "where": lambda c, a, b: F.when(c, a).otherwise(b)}


def formula(text: str, columns: Sequence[str]) -> Column:
    """A row formula as a column: + - * / ** %, comparisons, sqrt, log, exp, abs, clip(x, low, high), where(condition, a, b), COL("name") and `name`.

    Names are looked up among the columns without regard to case; an unknown name or function is a KeyError.
    """
    known = {c.lower(): c for c in columns}

    def build(node: ast.AST) -> Column:
        match node:
            case ast.BinOp(left, op, right):
                return _BINARY[type(op)](build(left), build(right))
            case ast.Compare(left, [op], [right]):
                return _BINARY[type(op)](build(left), build(right))
            case ast.UnaryOp(ast.USub(), operand):
                return -build(operand)
            case ast.UnaryOp(ast.UAdd(), operand):
                return build(operand)
            case ast.Constant(int() | float() as value):
                return F.lit(float(value))
            case ast.Name(name) | ast.Call(ast.Name("COL"), [ast.Constant(str() as name)], []):
                return F.col(f"`{known[name.lower()]}`").cast("double")
            case ast.Call(ast.Name(name), arguments, []):
                return _FUNCTIONS[name](*map(build, arguments))
        raise ValueError(text)

    return build(ast.parse(re.sub("`([^`]*)`", r'COL("\1")', text), mode="eval").body)


def crosswalk_project(df: DataFrame, targets: Sequence[Target], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """df's kept columns with all targets that can be made, in one projection; and target, status for each."""
    made, status = [], []
    for t in targets:
        try:
            column = formula(t.formula, df.columns) if t.formula else formula(f"`{t.source}`", df.columns)
            made.append(column.cast("double").alias(t.name))
            status.append((t.name, "formula" if t.formula else "copied"))
        except KeyError as e:
            status.append((t.name, f"missing {e.args[0]}"))
        except (ValueError, SyntaxError, TypeError):
            status.append((t.name, "not understood"))
    return df.select(*keep, *made), df.sparkSession.createDataFrame(status, "target string, status string")


# ---- manifests ---------------------------------------------------------------------------------------------------------------


def manifest(paths: DataFrame, column: str = "path") -> DataFrame:
    """Image files by field and channel in the order of the time stamp in their names, frames numbered from 0, with target names.

    Names look like <name>_<field>_<channel>_2024y01m31d_23h59m.tif; a name without stamp sorts first.
    """
    name = F.regexp_extract(column, r"([^/]+)\.\w+$", 1)
    stamp = F.regexp_extract(name, r"\d{4}y\d{2}m\d{2}d_\d{2}h\d{2}m", 0)
    value = F.when(stamp == "", F.lit(0)).otherwise(F.regexp_replace(stamp, r"\D", "").cast("long"))
    parts = paths.select(column, F.regexp_extract(name, r"^(.+?)_([A-Z]\d{1,2}-?\d*)_([^_]+)_", 2).alias("field"), F.regexp_extract(name, r"^(.+?)_([A-Z]\d{1,2}-?\d*)_([^_]+)_", 3).alias("channel"), value.alias("stamp"))
    frame = (F.row_number().over(Window.partitionBy("field", "channel").orderBy("stamp", column)) - 1).alias("frame")
    numbered = parts.select("*", frame)
    return numbered.withColumn("target", F.concat_ws("_", "field", "channel", F.concat(F.lit("t"), F.lpad(F.col("frame").cast("string"), 4, "0"))))


def file_paths(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """Paths of a folder's files; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path")


def manifest_select(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a manifest by field_channel or field|channel, without regard to case and zeros in front of numbers."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"(?<=[a-z])0+(?=\d)", "")
    wanted = [re.sub(r"(?<=[a-z])0+(?=\d)", "", k.lower().replace("|", "_")) for k in keys]
    return files.where(F.concat_ws("_", plain("field"), plain("channel")).isin(*wanted))


def plate_layout(files: DataFrame, layout: Mapping[str, Mapping[int, Sequence[str]]], well: str = "well") -> DataFrame:
    """Treatments of each file's well from a plate: row letter, column number, treatments by slot; joined by & in the order of slots."""
    spark = files.sparkSession
    rows = [(r, int(c), i, str(t)) for r, columns in layout.items() for c, slots in columns.items() for i, t in enumerate(slots) if t]
    plate = spark.createDataFrame(rows, "row string, col int, slot int, treatment string")
    wells = plate.groupBy("row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", "treatment"))), lambda s: s["treatment"]), "&").alias("treatments"))
    parsed = files.withColumns({"row": F.regexp_extract(well, r"^([A-Z])0*(\d+)$", 1), "col": F.nullif(F.regexp_extract(well, r"^([A-Z])0*(\d+)$", 2), F.lit("")).cast("int")})
    return parsed.join(F.broadcast(wells), ["row", "col"], "left")  # one row for each well of a plate
