"""Sources: strict and tolerant JSON lines, stores, cache, scholarly records, streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.plans import streams as S
from lodestone.sources import jsonl, scholarly, store
from lodestone.streaming import events as E

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])


def test_strict_and_tolerant_reads(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "é/x"}\n{"a": 2}\n{"a": 3, "b"', encoding="utf8")
    with pytest.raises(Exception):
        jsonl.read_strict(spark, str(p), SCHEMA).collect()
    rows, rejects = jsonl.read_tolerant(spark, str(p), SCHEMA)
    assert sorted((r.a, r.b) for r in rows.collect()) == [(1, "é/x"), (2, None)]
    assert [r.line for r in rejects.collect()] == ['{"a": 3, "b"']


def test_canonical_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é/x"), (2, None)], "b int, a string")
    jsonl.write_canonical(df, str(tmp_path / "o"))
    lines = sorted(x for f in (tmp_path / "o").glob("part-*") for x in f.read_text(encoding="utf8").splitlines())
    assert lines == ['{"a":"é/x","b":1}', '{"a":null,"b":2}']


def test_scan_papers(spark, tmp_path):
    for p in ("p1", "p2"):
        (tmp_path / p).mkdir()
        (tmp_path / p / "chunks.jsonl").write_text('{"a": 1, "b": "x"}\n')
    assert sorted(r.paper for r in jsonl.scan_papers(spark, str(tmp_path), None, SCHEMA).collect()) == ["p1", "p2"]
    assert jsonl.scan_papers(spark, str(tmp_path), ["p2"], SCHEMA).count() == 1


def test_upsert_and_delete_guard(spark):
    cur = spark.createDataFrame([(i, "old") for i in range(10)], "k int, v string")
    up = store.upsert(cur, spark.createDataFrame([("new", 3), ("new", 42), ("new", 42)], "v string, k int"), "k")
    assert {r.k: r.v for r in up.collect()} == {**{i: "old" for i in range(10)}, 3: "new", 42: "new"}
    with pytest.raises(ValueError):
        store.delete(cur, cur.where("k < 5"), "k", most=0.1)
    assert store.delete(cur, cur.where("k = 1"), "k", most=0.1).count() == 9


def test_cache_computes_each_miss_once(spark):
    rows = spark.createDataFrame([("x", "one"), ("y", "one"), ("z", "two"), ("n", None)], "id string, text string")
    empty = spark.createDataFrame([], "key string, value array<float>")
    full, made = store.through_cache(rows, empty, ["text"], "v1", store.hashing_embedder(8))
    assert made.count() == 3 and full.count() == 4
    again, none = store.through_cache(rows, made, ["text"], "v1", store.hashing_embedder(8))
    assert none.count() == 0 and again.count() == 4
    assert store.through_cache(rows, made, ["text"], "v2", store.hashing_embedder(8))[1].count() == 3


def test_scholarly_records(spark):
    work = {"id": "W1", "title": " A Title ", "doi": "https://doi.org/10.1/ABC", "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "N"}}]}
    w = scholarly.works(spark.createDataFrame([(json.dumps(work),), ('{"id": "W2"}',)], "json string")).collect()
    assert len(w) == 1 and (w[0].title, w[0].doi, w[0].abstract, w[0].authors) == ("A Title", "10.1/abc", "a b a", ["N"])
    xml = "<entry><id>http://x/abs/1706.03762v5</id><title>Some\n  Title</title><summary> s </summary><published>2017-06-12T00:00:00Z</published><author><name>A</name></author></entry>"
    e = scholarly.entries(spark.createDataFrame([(xml,), ("<!DOCTYPE x>" + xml,)], "xml string")).collect()
    assert len(e) == 1 and (e[0].source_id, e[0].title, e[0].year, e[0].authors) == ("1706.03762", "Some Title", 2017, ["A"])
    p = spark.createDataFrame([("s1", "T", 2020, "10.1/a"), ("s2", "T2", 2020, "10.1/a"), ("s3", "U", None, None), ("s4", " u ", None, "")], "source_id string, title string, year int, doi string")
    assert sorted(r.source_id for r in scholarly.distinct_papers(p).collect()) == ["s1", "s3"]


def test_streams_equal_batches(spark, tmp_path):
    df = spark.sql("SELECT id event_id, id % 3 user_id, timestamp_seconds(id * 60) ts FROM range(500)")
    df.repartition(4).write.parquet(str(tmp_path / "ev"))
    s = E.read_stream(spark, str(tmp_path / "ev"), files=1)
    got = {r.user_id: r.event_id for r in E.run_batches(s, "user_id", ["ts", "event_id"]).collect()}
    assert got == {0: 498, 1: 499, 2: 497}


def test_watermarked_streams_do_not_depend_on_the_files(spark, tmp_path):
    df = spark.sql("SELECT id % 4000 event_id, 'type' || id % 3 event_type, timestamp_seconds(1700006400 + id % 4000 * 600) ts, id % 7 / 4D value FROM range(4400)")
    df.repartition(16).write.parquet(str(tmp_path / "events.parquet"))
    assert len(list((tmp_path / "events.parquet").glob("part-*"))) == 16
    last = 1700006400 + 3999 * 600 - 600
    want = sorted(tuple(r) for r in S.events_tumbling(spark, str(tmp_path)).collect() if r.start_s + 3600 <= last)
    assert sorted(tuple(r) for r in S.stream_tumbling(spark, str(tmp_path)).collect()) == want
    got = S.stream_deduplicated(spark, str(tmp_path)).groupBy("day").agg(F.sum("n").alias("n")).collect()
    days = df.dropDuplicates(["event_id"]).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).count().collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in days)


def test_a_stream_resumes_from_its_checkpoint(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b).write.mode("append").parquet(str(tmp_path / "in"))
    rows(0, 5)
    once = lambda: sorted(r.id for r in E.run(E.read_stream(spark, str(tmp_path / "in")), base=str(tmp_path / "state")).collect())
    assert once() == list(range(5)) == once()  # nothing is read twice
    rows(5, 8)
    assert once() == list(range(8))


def test_upsert_keeps_the_greatest_of_repeated_keys(spark):
    current = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    changes = spark.createDataFrame([("z", "a", 5), ("y", "a", 7), (None, "c", 1)], "s string, k string, n int")
    got = {r.k: (r.n, r.s) for r in store.upsert(current, changes, "k").collect()}
    assert got == {"a": (7, "y"), "b": (2, "x"), "c": (1, None)}
