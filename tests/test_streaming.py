import datetime as dt

from pyspark.sql import functions as F

from unisource import schemas
from unisource.streaming.jobs import stream_latest_status, stream_payloads, write_stream


def test_payload_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "landed")
    for i in range(3):
        rows = [("s", "rest", "e", f"p{i}{k}", 200, f'{{"none":0,"rows":[{{"n":{i}}},{{"n":{k}}}]}}') for k in range(4)]
        spark.createDataFrame(rows, schemas.LANDED).write.mode("append").parquet(folder)
    rows = stream_payloads(spark, folder, "rest_rows", max_files=1).withColumn("row", F.to_json("row"))
    query = write_stream(rows, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = sorted((r["path"], r["row_no"], r["row"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted(x for i in range(3) for k in range(4) for x in ((f"p{i}{k}", 0, f'{{"n":{i}}}'), (f"p{i}{k}", 1, f'{{"n":{k}}}')))


def test_latest_status_stream(spark, tmp_path):
    folder = str(tmp_path / "tests")
    for i, ok in enumerate([True, False, True]):
        row = (str(i), "a", ok, i, "m", dt.datetime(2024, 1, 1 + i))
        spark.createDataFrame([row], schemas.CONNECTION_TESTS).write.mode("append").parquet(folder)
    query = (
        stream_latest_status(spark, folder).writeStream.format("memory").queryName("latest").outputMode("complete")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.table("latest").collect()
    assert [(r["source_id"], r["status"], r["test_latency_ms"]) for r in got] == [("a", "active", 2)]
