import pytest

from quire.llm import warc
from quire.llm.workspace import materialise

PAGES = "page_id long, url string, html string"


def pages(spark, n=700):
    rows = [(k, f"http://h{k % 7}.org/{k}", "x" * (k * 37 % 900)) for k in range(n)]
    rows += [(None, None, None), (None, "u", "v"), (3, "http://again", "y"), (3, "http://again", "y")]
    return spark.createDataFrame(rows, PAGES)


def brute(first, second):
    key = lambda r: (r.file, r.offset)
    a, b = {}, {}
    for rows, out in ((first, a), (second, b)):
        for r in rows:
            out.setdefault(key(r), []).append(r)
    out = []
    for k in a.keys() | b.keys():
        one, two = (sorted(x.get(k, []), key=lambda r: (r.length, r.digest, r.page_id or -1)) for x in (a, b))
        for j in range(max(len(one), len(two))):
            x, y = (r[j] if j < len(r) else None for r in (one, two))
            if x and y and (x.length, x.digest) == (y.length, y.digest):
                continue
            out.append((*k, (x or y).page_id, "missing" if not y else "extra" if not x else "corrupt"))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "fanout"), [(warc.RANGE, warc.FANOUT), (1000, 2)])
def test_audit_matches_a_full_comparison(spark, size, fanout):
    records = materialise(warc.write_records(pages(spark)), "t")
    first = materialise(warc.fixity(records), "t1")
    second = materialise(warc.fixity(warc.damaged(records)), "t2")
    got = sorted((tuple(r) for r in warc.audit(first, second, size, fanout).collect()), key=str)
    assert got == brute(first.collect(), second.collect())
    assert {r[3] for r in got} == {"corrupt", "missing"}
    assert {r.status for r in warc.audit(second, first, size, fanout).collect()} == {"corrupt", "extra"}


def test_equal_replicas_and_empty_ones(spark):
    records = materialise(warc.fixity(warc.write_records(pages(spark, 50))), "t")
    none = materialise(warc.fixity(warc.write_records(spark.createDataFrame([], PAGES))), "t")
    assert warc.audit(records, records).collect() == [] and warc.audit(none, none).collect() == []
    assert warc.audit(records, none).count() == 54
    assert {r.status for r in warc.audit(none, records).collect()} == {"extra"}


def test_only_differing_branches_are_entered(spark):
    records = materialise(warc.fixity(warc.write_records(pages(spark))), "t")
    spoilt = materialise(records.withColumn("digest", warc.F.when(warc.F.col("page_id") == 100, "0").otherwise(warc.F.col("digest"))), "t")
    ranges = warc.differing_ranges(warc.tree(records, "a", 1000, 4), warc.tree(spoilt, "b", 1000, 4), 4)
    assert ranges.count() == 1


def test_offsets_are_gapless(spark):
    rows = warc.write_records(pages(spark)).collect()
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append(r)
    for own in files.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.record.encode())
            at += r.length


def test_query_form_equals_written_records(spark, monkeypatch):
    for crowded in (warc.CROWDED, 50):
        monkeypatch.setattr(warc, "CROWDED", crowded)
        records = materialise(warc.write_records(pages(spark)), "t")
        want = warc.audit(materialise(warc.fixity(records), "t1"), materialise(warc.fixity(warc.damaged(records)), "t2"))
        assert sorted(map(tuple, warc.fixity_audit(pages(spark)).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_crowded_files_are_dealt_out_and_keep_their_names(spark, monkeypatch):
    monkeypatch.setattr(warc, "CROWDED", 20)
    monkeypatch.setattr(warc, "COPIES", 7)
    df = spark.createDataFrame([(5, "u", str(k)) for k in range(200)] + [(5, "u", "copy")] * 100 + [(None, "n", None)] * 30, PAGES)
    rows = sorted(map(tuple, warc.write_records(df).collect()), key=str)
    assert len(rows) == 330 and len({r[:2] for r in rows}) == 330
    assert rows == sorted(map(tuple, warc.write_records(df.repartition(5)).collect()), key=str)
    sizes = {}
    for file, *_, record in rows:
        sizes.setdefault(file, set()).add(record)
    assert len(sizes) > 5 and max(map(len, sizes.values())) < 60
