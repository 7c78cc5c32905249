import json

import pytest
from pyspark.sql import functions as F

from quire.sources import files
from quire.sources.snapshots import SnapshotStore, assert_unique, upsert


def test_scan(spark, tmp_path):
    (tmp_path / "b_c.md").write_bytes("é\r\nx\r".encode())
    (tmp_path / "a%20+.md").write_text("a")
    (tmp_path / "n.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("no")
    rows = files.scan_markdown(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.title, r.text) for r in rows] == [("a%20+.md", "a%20+", "a"), ("b_c.md", "b c", "é\nx\n")]
    assert rows[1].md5 != rows[1].text_md5 and rows[0].md5 == rows[0].text_md5
    assert [r.filename for r in files.scan_markdown(spark, str(tmp_path), 1).collect()] == ["a%20+.md"]


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", "h1", 2), ("b", "h2", 3), ("c", "h3", 1)], "filename string, md5 string, chunk_count int")
    new = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("d", "h4")], "filename string, md5 string")
    diff = files.manifest_diff(old, new)
    assert {r.filename: r.status for r in diff.collect()} == {"a": "unchanged", "b": "modified", "c": "removed", "d": "new"}
    assert {r.filename for r in files.to_add(diff).collect()} == {"b", "d"}
    assert sorted(r.chunk_id for r in files.deleted_chunk_ids(diff).collect()) == ["b::0", "b::1", "b::2", "c::0"]


def test_cache_miss(spark):
    listing = spark.createDataFrame([(x, "h") for x in "abcd"], "filename string, text_md5 string")
    cache = spark.createDataFrame([("a", "h", 2), ("b", "other", 2), ("c", "h", 1)], "filename string, content_hash string, schema_version int")
    assert {r.filename for r in files.cache_miss(listing, cache, 2).collect()} == {"b", "c", "d"}


def test_json_imports(spark, tmp_path):
    (tmp_path / "abbr.json").write_text(json.dumps({"cnn": "first", "CNN": "Convolutional Neural Network"}))
    assert [tuple(r) for r in files.read_abbreviations(spark, str(tmp_path / "abbr.json")).collect()] == [("cnn", "Convolutional Neural Network")]
    cache = {"p.md": {"content_hash": "h", "title": "p", "schema_version": 2, "entities": [{"name": "A", "type": "Task"}], "relations": [], "mentions": [{"name": "A", "type": "Task", "chunk_index": 3}]}}
    (tmp_path / "cache.json").write_text(json.dumps(cache))
    row = files.read_extraction_json(spark, str(tmp_path / "cache.json")).first()
    assert row.filename == "p.md" and row.entities[0].name == "A" and row.mentions[0].chunk_index == 3 and row.performances == []


def test_index_dump(spark):
    df = spark.createDataFrame([("a::0", None, "xy"), ("b::0", "b", "z")], "chunk_id string, source string, text string")
    assert [tuple(r) for r in files.index_dump(df).collect()] == [("a::0", "?", 2, "xy"), ("b::0", "b", 1, "z")]


def test_snapshots_commit_together(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    assert store.versions() == [] and store.read("t", "k int").collect() == []
    assert store.commit({"t": spark.range(2).select(F.col("id").cast("int").alias("k"))}) == 1
    with pytest.raises(Exception, match="boom"):
        store.commit({"t": store.read("t", "k int").withColumn("k", F.raise_error(F.lit("boom")).cast("int"))})
    assert store.versions() == [1] and store.read("t", "k int").count() == 2
    assert store.commit({"t": upsert(store.read("t", "k int"), spark.createDataFrame([(1,), (5,)], "k int"), ["k"])}) == 2
    assert sorted(r.k for r in store.read("t", "k int").collect()) == [0, 1, 5]
    assert_unique(store.read("t", "k int"), ["k"])
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])
