from pyspark.sql import functions as F

from veilsift.operators.scan import scan_rules
from veilsift.sources import load_cache, prepare_files
from veilsift.streaming import issues_per_window, once_per_diff, scan_stream, start_cached_scan
from workloads import registry
from workloads.registry import QUERIES
from workloads.views import PLANTED

SCHEMA = "repo_id int, file_idx long, file_path string, diff string, ts timestamp"


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "repo_id int, file_idx long, file_path string, diff string, ts string")
    df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def files(start, picks, hour=1):
    return [(1, start + i, "src/a.ts", f"+{PLANTED[p]}", f"2024-01-01 0{hour}:0{i}:00")
            for i, p in enumerate(picks)]


def test_cached_scan_skips_known_diffs(spark, tmp_path):
    folder, cache, out, state = (str(tmp_path / n) for n in ("in", "cache", "out", "state"))
    arrive(spark, folder, files(0, [0, 16, 43]))
    start_cached_scan(source(spark, folder), cache, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    assert load_cache(spark, cache).count() == 2  # the placeholder diff is LOW
    arrive(spark, folder, files(10, [0, 17, 43]))
    start_cached_scan(source(spark, folder), cache, out, state).awaitTermination()
    rows = spark.read.parquet(out).collect()
    # 10 repeats a stored diff; 12 repeats one that was LOW and so is scanned again
    assert sorted(r.file_idx for r in rows) == [0, 1, 2, 10, 11, 12]
    by_file = {r.file_idx: r for r in rows}
    assert [k for k, r in by_file.items() if r.from_cache] == [10]
    assert by_file[10].overall_risk == by_file[0].overall_risk and by_file[10].issues == by_file[0].issues
    assert load_cache(spark, cache).count() == 3
    # a retry of the second batch does not see its own entries
    assert load_cache(spark, cache, skip_part="batch-1").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, files(0, range(0, 9)))
    query = scan_stream(source(spark, folder)).select("file_idx", "overall_risk").writeStream.format(
        "memory").queryName("rows").option("checkpointLocation", str(tmp_path / "s")).trigger(
        availableNow=True).start()
    query.awaitTermination()
    batch = scan_rules(prepare_files(spark.read.parquet(folder))).select("file_idx", "overall_risk")
    assert sorted(spark.table("rows").collect()) == sorted(batch.collect())


def test_once_per_diff(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, files(0, [0, 0, 1, 0]))
    prepared = once_per_diff(prepare_files(source(spark, folder)), "ts", "1 hour")
    query = prepared.writeStream.format("memory").queryName("once").option(
        "checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 2


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, files(0, [0, 1, 16]) + files(5, [0], hour=3))
    counts = issues_per_window(scan_rules(source(spark, folder)), "ts")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("w").option(
        "checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {(r.window_start.hour, r.severity): r.n_issues for r in spark.table("w").collect()}
    assert rows == {(1, "HIGH"): 2, (1, "MEDIUM"): 1, (3, "HIGH"): 1}


def test_windows_in_append_mode_drop_late_rows(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, files(0, [0, 0]) + files(5, [0], hour=3))
    counts = issues_per_window(scan_rules(source(spark, folder)), "ts", delay="30 minutes")
    out, state = str(tmp_path / "out"), str(tmp_path / "s")

    def run():
        counts.writeStream.outputMode("append").format("parquet").option("path", out).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.window_start.hour, r.severity, r.n_issues) for r in spark.read.parquet(out).collect())

    assert run() == [(1, "HIGH", 2)]  # the window at 3 is open
    arrive(spark, folder, files(10, [0, 0, 0]) + files(15, [0], hour=3) + files(20, [0], hour=5))
    assert run() == [(1, "HIGH", 2), (3, "HIGH", 2)]  # three rows of the window at 1 came too late


def test_document_stream_reads_a_file_and_a_folder(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k}", "en") for k in range(60)], "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    docs.write.parquet(f"{tmp_path}/file/other.parquet")  # not part of the table
    folder, file = ([tuple(r) for r in QUERIES["stream_scan"](spark, f"{tmp_path}/{n}").collect()] for n in ("folder", "file"))
    assert sorted(folder) == sorted(file) and 0 < len(file) == len({r[0] for r in file})


def test_arrivals_are_one_batch_each_of_many_files(spark, tmp_path):
    rows, seen = spark.range(0, 90, 1, 5), []

    def look(batch, batch_id):
        seen.append((batch_id, sorted(r.id for r in batch.collect())))

    def start(stream, trigger):
        return stream.writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/s").trigger(**trigger).start()

    registry._arrivals(spark, rows, [F.col("id") % 3 == i for i in range(3)], str(tmp_path), start)
    assert seen == [(k, list(range(k, 90, 3))) for k in range(3)]
    assert len(list((tmp_path / "arrivals").glob("*.parquet"))) == 15  # five tasks wrote each batch


def test_events_of_one_row_group_are_spread(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT id AS event_id, timestamp_seconds(1700000000 + 60 * id) AS ts, 'click' AS event_type, '{}' AS props
                 FROM range(2000)""").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    run, tasks = registry._arrivals, []

    def counted(spark, df, *rest):
        tasks.append(df.rdd.getNumPartitions())
        run(spark, df, *rest)

    monkeypatch.setattr(registry, "_arrivals", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "4k")
    try:
        assert QUERIES["stream_windows"](spark, str(tmp_path)).count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert tasks[0] > 1
