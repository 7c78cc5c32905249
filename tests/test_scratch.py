import pyarrow as pa
import pytest

from quire.sources import scratch


def test_tables_live_in_the_shared_folder_until_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_root", lambda _: f"file://{tmp_path}")
    df = scratch.materialise(spark.range(5).toDF("k"), "t")
    own = tmp_path / "quire" / spark.sparkContext.applicationId
    (tmp_path / "quire" / "other").mkdir()
    assert df.count() == 5 and len(list(own.iterdir())) == 1
    scratch.clear(spark)
    assert not own.exists() and (tmp_path / "quire" / "other").exists()


def test_batches_are_small_while_a_table_is_written(spark):
    before = spark.conf.get(scratch.BATCH_SETTING)
    rows = spark.range(0, 5000, 1, 1).mapInArrow(lambda b: (pa.RecordBatch.from_pydict({"n": [x.num_rows]}) for x in b), "n long")
    assert max(r.n for r in scratch.materialise(rows, "t").collect()) == scratch.BATCH_ROWS
    assert spark.conf.get(scratch.BATCH_SETTING) == before


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session())
