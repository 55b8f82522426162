import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from nightledger.operators import stats
from nightledger.operators.merge import table_rows
from nightledger.streaming import imports


def export(folder, name, rows, head="ExposureStart,TargetName,Filter,ExposureTime,HFR,FilePath"):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}ImageMetaData.csv", "w") as f:
        f.write("\n".join([head, *rows]) + "\n")


def row(day, target, name, seconds=60, hfr=2.0):
    return f"2024-01-{day:02} 22:00:{seconds % 60:02},{target},L,{seconds},{hfr},{name}"


def columns(rows):
    return sorted(str((r.timestamp, r.target_name, r.exposure_seconds, r.file_path)) for r in rows)


def test_nothing_comes_in_twice(spark, tmp_path):
    root, table, sums = (f"{tmp_path}/{x}" for x in ("in", "table", "sums"))
    run = lambda name, state, **how: imports.import_exposures(spark, root, table, f"{tmp_path}/{state}", sums, name, **how).awaitTermination()
    export(f"{root}/a", "1", [row(1, "M31", "f1"), row(1, "M31", "f1"), row(2, "M33", "f2"), row(2, "M42", "")])
    run("one", "s1")
    schema = spark.read.parquet(table).drop("part").schema
    read = lambda: table_rows(spark, table, schema).collect()
    first = columns(read())
    assert len(first) == 3 and {r["part"] for r in read()} == {"2024-01-01", "2024-01-02"}
    run("one", "s1")  # restarted: nothing new
    assert columns(read()) == first
    export(f"{root}/b", "2", ["L,f1,2024-01-01 22:00:00,60", "L,f9,2024-01-09 22:00:00,30"], "Filter,FilePath,Date,Duration")  # f1 again in another layout, whenever it comes
    run("one", "s1", most=1)
    assert len(read()) == 4
    before = {f: os.stat(f).st_mtime_ns for d, _, names in os.walk(table) for f in (os.path.join(d, n) for n in names) if "part-" in f and "_ledger" not in f}
    new = spark.read.schema(schema).parquet(table).where("import_batch = 'one-0'").drop("part", imports.BATCH)
    assert imports.import_rows(table, new, "one-0", list(imports.EXPOSURE_KEY), "source_path", imports.night()) == []  # the same batch after a failure
    assert before == {f: os.stat(f).st_mtime_ns for f in before}
    summary = imports.running_summary(spark, sums, stats.session_summary(table_rows(spark, table, schema)).schema)
    assert sorted(summary.collect()) == sorted(stats.session_summary(table_rows(spark, table, schema)).select(*summary.columns).collect())


def test_weather_comes_once_a_folder(spark, tmp_path):
    root = f"{tmp_path}/in"
    for name in ("a", "b"):
        os.makedirs(f"{root}/{name}")
        for k in (1, 2):
            with open(f"{root}/{name}/{k}WeatherData.csv", "w") as f:
                f.write("Date,Temperature\n" + "".join(f"2024-01-0{d} 20:00:00,{d}.5\n" for d in range(1, k + 2)))
    imports.import_weather(spark, root, f"{tmp_path}/table", f"{tmp_path}/s").awaitTermination()
    imports.import_weather(spark, root, f"{tmp_path}/table", f"{tmp_path}/other", "later").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/table").count() == 6


def test_streamed_nights_equal_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1, 18)
    rows = [(start + timedelta(hours=k), f"t{k % 7}", f"f{k % 3}", "T1" if k % 2 else None, 60.0 * (k % 4), None if k % 5 == 0 else k / 10, 2.0 + k % 3) for k in range(200)]
    frame = spark.createDataFrame(rows, "timestamp timestamp, target_name string, filter_name string, telescope string, exposure_seconds double, hfr double, fwhm double")
    for n, part in enumerate((frame.where("timestamp < '2024-01-05'"), frame.where("timestamp >= '2024-01-05'"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streamed = imports.stream_night_summary(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
        streamed.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {r.session_date: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    nights = frame.withColumn("session_date", F.to_date(F.col("timestamp") - F.expr("INTERVAL 12 HOURS")))
    want = {r.session_date: r for r in stats.session_summary(nights).collect()}
    assert len(got) >= 5
    for day, r in got.items():
        for c in want[day].asDict():
            a, b = r[c], want[day][c]
            assert a == b or abs(a - b) < 1e-9, (day, c, a, b)
