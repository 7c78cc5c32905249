import json
import os

import pytest

from quire.__main__ import run
from quire.functions import models
from quire.plans import flows
from quire.sources import files
from quire.sources.snapshots import SnapshotStore


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "data").mkdir()
    for k in range(4):
        (tmp_path / "data" / f"p{k}.md").write_text(f"# T\ntext {k}\n")
    return tmp_path / "data"


def texts(store):
    return {r.chunk_id: r.text for r in store.read("chunks", flows.CHUNKS).collect()}


def test_only_candidates_are_read(spark, folder, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")

    def update():
        return flows.update_index_folder(spark, str(folder), store, models.HashEmbedder)

    assert update() == 1 and len(texts(store)) == 4
    assert update() is None and store.versions() == [1]
    old = (folder / "p1.md").stat()
    (folder / "p1.md").write_text("# T\ntext X\n")  # as long as before, and its time put back: only a read would show it
    os.utime(folder / "p1.md", ns=(old.st_atime_ns, old.st_mtime_ns))
    (folder / "p2.md").write_text("# T\ntext 2 changed\n")
    (folder / "p3.md").unlink()
    (folder / "p4.md").write_text("# T\nnew\n")
    update()
    assert texts(store) == {"p0.md::0": "# T\ntext 0", "p1.md::0": "# T\ntext 1", "p2.md::0": "# T\ntext 2 changed", "p4.md::0": "# T\nnew"}
    os.utime(folder / "p1.md", ns=(1, old.st_mtime_ns + 10**10))
    update()
    assert texts(store)["p1.md::0"] == "# T\ntext X"
    chunks = store.content()["chunks"]
    os.utime(folder / "p0.md", ns=(1, old.st_mtime_ns + 10**10))  # the same bytes at another time
    listing = files.list_markdown(spark, str(folder))
    assert files.to_look_at(store.read("manifest", flows.MANIFEST), listing).count() == 1
    assert update() is None and store.content()["chunks"] == chunks
    assert files.to_look_at(store.read("manifest", flows.MANIFEST), listing).count() == 0


def test_a_listing_reads_no_content(spark, folder):
    plan = files.list_markdown(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("named", [10, 1])
def test_many_candidates_are_joined(spark, folder, monkeypatch, named):
    monkeypatch.setattr(files, "NAMED_FILES", named)
    wanted = files.list_markdown(spark, str(folder)).filter("filename <> 'p0.md'")
    assert sorted(r.filename for r in files.read_files(spark, str(folder), wanted).collect()) == ["p1.md", "p2.md", "p3.md"]
    assert files.read_files(spark, str(folder), wanted.limit(0)).count() == 0


def cache(n):
    return {
        f"p{k}.md": {
            "content_hash": f"h{k}", "title": f"T {k}" + " },\n  }, {", "schema_version": 2, "entities": [{"type": "Method", "name": "a\n  },\n"}], "relations": [{"head": "x", "relation": "USES", "tail": f"m{k}"}],
            "mentions": [{"chunk_index": j, "type": "Method", "name": f"m{j}"} for j in range(k % 4)],
        }
        for k in range(n)
    }


def loaded(spark, path):
    return sorted(map(str, files.read_extraction_json(spark, str(path)).collect()))


def test_caches_of_any_layout(spark, tmp_path):
    for n in (1, 2, 40):
        for name, how in (("two", {"indent": 2}), ("four", {"indent": 4}), ("flat", {})):
            (tmp_path / f"{name}.json").write_text(json.dumps(cache(n), ensure_ascii=False, **how))
        assert loaded(spark, tmp_path / "two.json") == loaded(spark, tmp_path / "four.json") == loaded(spark, tmp_path / "flat.json")
        assert len(loaded(spark, tmp_path / "two.json")) == n
    for ends in ({"a.md": {}, **cache(2)}, {**cache(2), "z.md": {}}, {"a.md": {}}, {}):
        for k, how in enumerate(({"indent": 2}, {})):
            (tmp_path / f"{k}.json").write_text(json.dumps(ends, **how))
        assert loaded(spark, tmp_path / "0.json") == loaded(spark, tmp_path / "1.json") and len(loaded(spark, tmp_path / "0.json")) == len(ends)


def test_a_large_cache_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(cache(12_000), indent=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        papers = files.read_extraction_json(spark, str(tmp_path / "c.json"))
        sizes = papers.groupBy(files.F.spark_partition_id()).count().collect()
        assert papers.select("filename").distinct().count() == 12_000 and len(sizes) >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_import_command(spark, folder, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(cache(3), indent=2))
    at = ["--store", f"file://{tmp_path}/lib"]
    assert list(run(spark, [*at, "import", "--cache", str(tmp_path / "c.json")])) == ["version 1"]
    for k in range(4):
        list(run(spark, [*at, "import", "--cache", str(tmp_path / "c.json")]))
    store = SnapshotStore(spark, f"file://{tmp_path}/lib/extractions")
    assert len(store.versions()) == 2  # older ones have gone
    assert sorted((r.filename, r.n_mentions) for r in store.read("extractions", flows.EXTRACTIONS).collect()) == [("p0.md", 0), ("p1.md", 1), ("p2.md", 2)]
    told = list(run(spark, [*at, "extract", "--data", str(folder)]))
    assert told[-2] == "4 of 4 papers" and told[-1].startswith("version ")
