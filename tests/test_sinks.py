"""Sinks and sources beyond files: batches with a fallback, databases, bitmaps and sketches beside rows, and streams with state."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import facets
from rostrum.operators import search as S
from rostrum.plans.views import view
from rostrum.sources import batched, jdbc
from rostrum.streaming import usage


def sink(folder, refused=(), once=None):
    """A service that keeps the last of each name, refuses groups with some ids and, once, fails after it has taken a group."""

    def send(name, rows):
        import os

        if any(r["id"] in refused for r in rows):
            raise ValueError(f"refused {len(rows)}")
        with open(f"{folder}/{name}", "w") as f:
            f.write(json.dumps([r["id"] for r in rows]))
        if once and not os.path.exists(once) and len(os.listdir(folder)) > 2:
            open(once, "w").close()
            os._exit(1)  # the worker is lost with its groups sent

    return send


def taken(folder):
    return sorted(i for p in folder.iterdir() for i in json.loads(p.read_text()))


def test_one_refused_document_fails_alone(spark, tmp_path):
    rows = spark.range(50).withColumn("text", F.lit("x")).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        told = batched.write_batched(rows, sink(str(tmp_path), {17}), "id", 50)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [x["id"] for x in told["failed"]] == [17] and told["failed"][0]["error"] == "refused 1" and told["sent"] == 49 and told["groups"] == 1
    assert taken(tmp_path) == [k for k in range(50) if k != 17]


def test_groups_and_a_task_that_is_tried_again(spark, tmp_path):
    (tmp_path / "s").mkdir()
    told = batched.write_batched(spark.range(500).withColumn("text", F.lit("x")), sink(str(tmp_path / "s")), "id", 20, "run")
    assert told["sent"] == 500 and told["failed"] == [] and 25 <= told["groups"] <= 29 and taken(tmp_path / "s") == list(range(500))
    names = {p.name: p.read_text() for p in (tmp_path / "s").iterdir()}
    batched.write_batched(spark.range(500).withColumn("text", F.lit("x")), sink(str(tmp_path / "s")), "id", 20, "run")  # the same run anew
    assert {p.name: p.read_text() for p in (tmp_path / "s").iterdir()} == names
    assert batched.write_batched(spark.range(0), sink(str(tmp_path / "s")), "id") == {"sent": 0, "groups": 0, "failed": []}


def test_a_lost_task_sends_the_same_groups(spark, tmp_path):
    """send_group over the same rows, cut off in the middle and begun anew, as a retried task does it."""
    (tmp_path / "s").mkdir()
    send, calls = sink(str(tmp_path / "s"), {3}), []

    def counted(name, rows):
        calls.append(name)
        if len(calls) == 3:
            raise SystemExit
        send(name, rows)

    def task():
        done = batched.Sent()
        for k in range(3):
            batched.send_group(counted, f"r-0-{done.groups}", [{"id": i} for i in range(k * 4, k * 4 + 4)], "id", done)
        return done

    with pytest.raises(SystemExit):
        task()
    done = task()
    assert [x["id"] for x in done.failed] == [3] and taken(tmp_path / "s") == [k for k in range(12) if k != 3]


def test_a_service_that_refuses_all_ends_the_write(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batched, "MOST_FAILED", 5)
    with pytest.raises(RuntimeError):
        batched.send_group(sink(str(tmp_path), set(range(9))), "n", [{"id": k} for k in range(9)], "id", batched.Sent())


def test_addresses():
    got = jdbc.options_of("mysql://u:p%40w@host:3306/db?useSSL=false")
    assert got == {"url": "jdbc:mysql://host:3306/db", "useSSL": "false", "user": "u", "password": "p@w"}
    with pytest.raises(ValueError):
        jdbc.options_of("host/db")
    parts = {"DB_HOST": "h", "DB_NAME": "n", "DB_USER": "u", "DB_PASSWORD": "p@:/w"}
    assert jdbc.options_of_environment(parts) == {"url": "jdbc:mysql://h:3306/n", "user": "u", "password": "p@:/w"}
    assert jdbc.options_of_environment(parts | {"DB_PORT": "7"})["url"] == "jdbc:mysql://h:7/n"
    assert jdbc.options_of_environment(parts | {"MYSQL_URL": "mysql://a:b@c/d"}) == {"url": "jdbc:mysql://c:3306/d", "user": "a", "password": "b"}
    with pytest.raises(ValueError):
        jdbc.options_of_environment({"DB_HOST": "h"})


@pytest.fixture
def derby(tmp_path):
    return {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_database_round_trip(spark, derby):
    rows = spark.createDataFrame([(k, f"k{k}", None if k % 5 == 0 else "é" * k) for k in range(100)], "n int, doc_key string, content string")
    types = "doc_key VARCHAR(64)"
    jdbc.append_once(rows.where("n < 60"), derby, "documents", "doc_key", "r1", types)
    jdbc.append_once(rows.where("n < 60"), derby, "documents", "doc_key", "r1", types)  # the run is repeated
    jdbc.append_once(rows.where("n >= 40").union(rows.where("n = 99")), derby, "documents", "doc_key", "r2", types)
    back = jdbc.read(spark, derby, "documents", "n", 7)
    assert back.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert min(back.groupBy(F.spark_partition_id()).count().collect(), key=lambda r: r[1])[1] > 5
    assert jdbc.read(spark, derby, "documents").count() == 100
    with pytest.raises(ValueError):
        jdbc.append_once(rows, derby, "documents", "doc_key", "r;drop")


def test_an_append_that_fails_leaves_nothing(spark, derby):
    rows = spark.createDataFrame([(1, "a")], "n int, doc_key string")
    jdbc.append_once(rows, derby, "t", "doc_key", "r1", "doc_key VARCHAR(64)")
    with pytest.raises(Exception, match="NO_SUCH|does not exist|ERROR"):
        jdbc.executed(spark, derby, ["INSERT INTO t VALUES (2, 'b')", "INSERT INTO no_such VALUES (1)"])
    assert jdbc.read(spark, derby, "t").count() == 1
    assert jdbc.read(spark, derby, "(SELECT * FROM t WHERE 1 = 0) x", "n").count() == 0


def test_bitmaps_equal_rows(spark, sf):
    docs = view(spark, sf, "docs_v").withColumn("doc_id", F.col("doc_id") * 1000)  # several buckets
    index = facets.bitmaps(docs, S.FACETS)
    kept = index.collect()
    index = spark.createDataFrame(kept, index.schema)
    for filters, where in (([], "true"), ([[("source", "src1")]], "source = 'src1'"), ([[("document_type", "Oral Question")], [("speaker", "HON. MEMBER C"), ("speaker2", "HON. MEMBER C")]], "document_type = 'Oral Question' and (speaker = 'HON. MEMBER C' or speaker2 = 'HON. MEMBER C')"), ([[("source", "none")]], "false")):
        hits = docs.where(where)
        want = sorted(map(tuple, S.field_facets(hits, most=10**6).collect()))
        assert sorted(map(tuple, facets.bitmap_facets(index, S.FACETS, filters).collect())) == want
        assert facets.bitmap_total(index, filters).first()["n"] == hits.count()
        zero = sorted(map(tuple, facets.bitmap_facets(index, ("source", "document_type"), filters, zero=True).collect()))
        assert zero == sorted(map(tuple, S.zero_facets(docs, hits, ("source", "document_type")).collect()))


def test_sketches_are_near_and_add_up(spark, sf):
    rows = spark.range(60_000).selectExpr("id % 20000 as person", "cast(id % 30 as int) as day", "if(id % 7 = 0, null, id) as other")
    old, new = facets.sketches(rows.where("day < 20"), ["day"], ("person", "other")), facets.sketches(rows.where("day >= 20"), ["day"], ("person", "other"))
    got = facets.estimated(old.union(new), ("person", "other")).first()
    assert abs(got["person"] - 20_000) < 400 and abs(got["other"] - rows.where("other is not null").count()) < 0.02 * 51_500
    docs = view(spark, sf, "docs_v").withColumn("month", F.trunc("sitting_date", "MM"))
    want = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.countDistinct("speaker").alias("n")).collect()}
    near = {r["source"]: r["speaker"] for r in facets.estimated(facets.sketches(docs, ["source", "month"], ("speaker",)), ("speaker",), ["source"]).collect()}
    assert set(want) == set(near) and all(abs(near[k] - want[k]) <= max(1, 0.02 * want[k]) for k in want)


@pytest.fixture
def shuffled(spark, sf, tmp_path):
    """Events in files that come out of order within two days."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts", "event_type").orderBy("ts").collect()]
    rng = random.Random(1)
    rows.sort(key=lambda r: r[2].timestamp() + rng.random() * 86_400)
    schema = "event_id long, user_id long, ts timestamp_ntz, event_type string"
    late = [(10**6 + k, k, rows[0][2], "late") for k in range(3)]
    for k in range(0, len(rows), 200):
        spark.createDataFrame(rows[k : k + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(rows, schema), late, schema, tmp_path


def streamed(spark, folder, name, schema, transform):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = usage.written(transform(source), str(folder / name), str(folder / f"{name}-c"))
    query.awaitTermination()
    return query


def test_streams_equal_batches_and_count_late_rows(spark, shuffled):
    events, late, schema, folder = shuffled
    sessions = lambda rows: usage.session_windows(rows.select("user_id", "ts"), late="2 days")
    windows = lambda rows: usage.counts_by_window(rows, "1 day", late="2 days")
    first = streamed(spark, folder, "s", schema, sessions)
    assert usage.dropped(first) == 0
    streamed(spark, folder, "w", schema, windows)
    last = events.agg(F.max("ts")).first()[0]
    # rows far behind are dropped and counted, and one far ahead closes what is open
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    again = streamed(spark, folder, "s", schema, sessions)
    assert usage.dropped(again) == 3
    streamed(spark, folder, "w", schema, windows)
    spark.createDataFrame([(10**7, 0, last.replace(year=last.year + 1), "end")], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    streamed(spark, folder, "s", schema, sessions), streamed(spark, folder, "w", schema, windows)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(spark.read.parquet(str(folder / "s"))) == rows(usage.sessions(events.select("event_id", "user_id", "ts")))
    assert rows(usage.top_of_windows(spark.read.parquet(str(folder / "w")))) == rows(usage.trending(events))
