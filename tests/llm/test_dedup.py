import hashlib
import re
from collections import defaultdict

import pytest
from cases import edge_docs, edge_rows, empty_docs

from quire.llm import dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), 1 << 63 if doc_id is None else doc_id))
    out = []
    for norm, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = False
        for m in sorted(members):
            own = m == best and not kept
            kept |= own
            out.append((None if m[1] == 1 << 63 else m[1], None if best[1] == 1 << 63 else best[1], len(members), own, sha))
    return out


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("limit", [dedup.TABLE_BYTES, 700])
def test_edge_rows_match_brute_force(spark, limit):
    got = [tuple(r) for r in dedup.grace_dedup(edge_docs(spark).repartition(5), limit).collect()]
    assert sorted(got, key=key) == sorted(brute(edge_rows()), key=key)


def test_partitions_go_through_the_table_in_parts(spark, monkeypatch):
    from quire.llm.workspace import pa

    rows = edge_rows()
    monkeypatch.setattr(dedup, "MEMBERS", 7)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([None if r[1] is None else r[1].encode() for r in rows], pa.binary()), pa.array([len(r[1] or "") for r in rows])], names=["doc_id", "text", "n"])
    monkeypatch.setattr(dedup.TaskContext, "get", lambda: type("Context", (), {"partitionId": lambda self: 0})())
    made = [r for b in dedup._local(iter([batch]), dedup.TABLE_BYTES) for r in b.to_pylist()]
    assert len(made) == len(rows) and sum(r["copies"] or 0 for r in made) == len(rows)
    heads = [r["rid"] for r in made if r["copies"]]
    assert all(r["head"] in heads for r in made) and len(heads) > len(brute(rows)) / 7


def test_spills_go_where_spark_says(tmp_path, monkeypatch):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", f"{tmp_path}")
    list(dedup.grace_groups([(bytes([k]) * 16, bytes([k]) * 100, k) for k in range(50)], limit=1000))
    assert dedup.spill_folder() == str(tmp_path) and list(tmp_path.iterdir()) == []
    monkeypatch.setenv("SPARK_LOCAL_DIRS", "")
    assert dedup.spill_folder() is None


def test_empty_table(spark):
    assert dedup.grace_dedup(empty_docs(spark)).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [tuple(r) for r in dedup.grace_dedup(docs).collect()]
    assert sorted(got, key=key) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=key)


def test_equal_digests_still_compare_contents(tmp_path):
    digest = b"\0" * 16
    records = [(digest, bytes([k % 7]) * 100, k) for k in range(70)]
    got = list(dedup.grace_groups(records, limit=300, folder=str(tmp_path)))
    assert sorted(len(m) for _, _, m in got) == [10] * 7
    assert not list(tmp_path.iterdir())


def test_columns_of_any_name_are_kept(spark):
    docs = edge_docs(spark)
    for name in ("grace digest", "grace row", "GRACE ROW_", "a.b"):
        docs = docs.withColumn(name, docs["doc_id"])
    kept = dedup.distinct_rows(docs)
    assert kept.columns == docs.columns and kept.count() == dedup.distinct_rows(edge_docs(spark)).count()
    assert all(r["grace digest"] == r["grace row"] == r["a.b"] == r["doc_id"] for r in kept.collect())
