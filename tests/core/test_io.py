import json

import pytest
from pyspark.sql import functions as F

from trackloom.sources import io


def test_stored_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("a", 2, None), (None, 3, 1.5), ("b c/d", 4, float("nan"))], "Experiment string, Parent long, area double")
    with pytest.raises(ValueError, match="no table"):
        io.read_tracks(spark, path)
    assert io.write_tracks(df, path)
    show = lambda d: sorted(map(str, d.select("Experiment", "Parent", "area").collect()))
    assert show(io.read_tracks(spark, path)) == show(df)
    before = sorted(p.name for p in (tmp_path / "table").rglob("*"))
    assert not io.write_tracks(df.orderBy(F.desc("Parent")), path, mode="overwrite") and not io.write_tracks(df, path)
    assert sorted(p.name for p in (tmp_path / "table").rglob("*")) == before
    more = df.unionAll(df)
    with pytest.raises(ValueError, match="another"):
        io.write_tracks(more, path)
    held = io.read_tracks(spark, path)
    assert io.write_tracks(more, path, mode="overwrite")
    assert show(held) == show(df) and show(io.read_tracks(spark, path)) == show(more)  # who reads the old version goes on
    assert io.drop_old_versions(spark, path) == 1 and show(io.read_tracks(spark, path)) == show(more)
    other = df.withColumn("label", F.lit(1))
    assert io.write_tracks(other, path, mode="overwrite") and io.read_tracks(spark, path).columns.count("label") == 1


def test_a_lost_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame([("a", 1)], "Experiment string, Parent long")
    io.write_tracks(df, path)
    broken = df.withColumn("Parent", F.when(F.rand() < 2, F.raise_error(F.lit("lost"))).cast("long"))
    with pytest.raises(Exception, match="lost"):
        io.write_tracks(broken, path, mode="overwrite")
    (tmp_path / "table" / "versions" / "half" / "Experiment=a").mkdir(parents=True)
    assert [tuple(r) for r in io.read_tracks(spark, path).select("Experiment", "Parent").collect()] == [("a", 1)]


def test_files_follow_the_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(3_000).select(F.when(F.col("id") < 2_900, "large").otherwise("small").alias("Experiment"), F.col("id").alias("Parent"))
    io.write_tracks(df, path, file_bytes=20_000)
    files = [p.parent.name for p in (tmp_path / "table" / "versions").rglob("*.parquet")]
    assert files.count("Experiment=large") == 6 and files.count("Experiment=small") == 1


def test_records(spark, tmp_path):
    rows = [("e1", "7", {"area": [1.0, float("nan")], "speed": []}), ("e,\"2", "8", {}), ("e3", "9", None)]
    df = spark.createDataFrame(rows, "Experiment string, Parent string, vectors map<string,array<double>>")
    lines = io.record_lines(df)
    bad = ["{", "[1]", '{"Experiment": "e"}', '{"Experiment": "e", "Parent": 1, "area": ["x"]}', '{"Experiment": "e", "Parent": 1, "area": 5}', "not json", "", "  "]
    every = lines.unionAll(spark.createDataFrame([(b,) for b in bad], "value string"))
    every.write.text(str(tmp_path / "lines"))
    got = io.read_records(spark, str(tmp_path / "lines")).collect()
    fine = {r.Experiment: r for r in got if r.corrupt is None}
    assert fine.keys() == {"e1", 'e,"2', "e3"} and fine["e1"].vectors["speed"] == [] and fine["e1"].vectors["area"][0] == 1.0 and str(fine["e1"].vectors["area"][1]) == "nan" and fine["e3"].vectors == {}
    assert sorted(r.corrupt for r in got if r.corrupt is not None) == sorted(bad[:6])
    (tmp_path / "array.json").write_text(json.dumps([{"Experiment": "e", "Parent": 3, "area": [1, 2.5, float("nan")]}, {"Experiment": "f", "Parent": 4}], indent=2))
    back = {r.Experiment: r for r in io.read_records(spark, str(tmp_path / "array.json"), array=True).collect()}
    assert back["e"].Parent == "3" and back["e"].vectors["area"][:2] == [1.0, 2.5] and back["f"].vectors == {} and all(r.corrupt is None for r in back.values())
