from trackloom.functions.columns import time_stamp
from trackloom.streaming import summaries


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).selectExpr("case id % 2 when 0 then 'a' else 'b' end as experiment", "cast(id as int) as time_index", "45.0D as dt", "cast(id * 7 % 31 as double) as area")
    rows = rows.withColumn("ds", time_stamp("time_index", "dt"))
    for i in range(4):
        rows.where(f"time_index div 100 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = summaries.track_stream(spark, str(tmp_path / "in"), rows.schema, files_at_once=1)
    for _ in range(2):  # the second run finds nothing new
        summaries.run_to_folder(summaries.windowed_summary(stream, "area"), str(tmp_path / "out"), str(tmp_path / "check"))
    batch = {(r.experiment, r.start): r.n for r in summaries.windowed_summary(rows, "area").collect()}
    closed = {(r.experiment, r.start): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(closed) > 50 and len(batch) - len(closed) <= 4  # the last windows are still open
    assert all(batch[k] >= n for k, n in closed.items())
