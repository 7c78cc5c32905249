import re
from collections import defaultdict

import corpus_pipeline
import pytest
from cases import edge_docs, empty_docs
from test_packing import check_pieces, ids_of, library  # noqa: F401
from test_quality import brute as brute_quality

from quire.llm import langid, queries
from quire.llm.workspace import materialise


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, materialise(f(spark, docs, sf_dir), name)
        out.append((name, before, docs))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert before.schema.simpleString() == after.schema.simpleString()
        old = rows(before)
        assert all(old[k] == r for k, r in rows(after).items())


def test_language_stage(stages):
    _, before, after = stages[0]
    verdict = {r.doc_id: r.lang_pred != "und" and r.bits_per_byte <= langid.MOST_BITS for r in langid.identify(before).collect()}
    assert set(rows(after)) == {k for k, kept in verdict.items() if kept}


def test_quality_stage(stages):
    _, before, after = stages[1]
    failed = {k for k, r in rows(before).items() if brute_quality(r.text)[-1]}
    kept = set(rows(after))
    assert not failed & kept and len(kept) > 0.6 * before.count()


def test_exact_stage(stages):
    _, before, after = stages[2]
    groups = defaultdict(list)
    for k, r in rows(before).items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), k))
    assert set(rows(after)) == {min(g)[1] for g in groups.values()}


def test_near_stage(stages):
    """Of texts with a similarity of 0.8 or more one stays; texts far from any other stay."""
    _, before, after = stages[3]
    texts = {k: r.text.lower().split() for k, r in rows(before).items()}
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, w in texts.items()}
    similar = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]]
    kept = set(rows(after))
    assert not [(a, b) for a, b, j in similar if j >= 0.9 and a in kept and b in kept]
    assert set(sets) - {k for a, b, j in similar if j >= 0.8 for k in (a, b)} <= kept


def test_packing_stage(stages, library):  # noqa: F811
    _, before, after = stages[4]
    check_pieces(after.collect(), {k: [ids_of(library, r.text)] for k, r in rows(before).items()})


def test_run_and_edges(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1][2].count()
    for make in (edge_docs, empty_docs):
        docs = make(spark)
        for name, f in corpus_pipeline.STAGES[:-1]:
            docs = materialise(f(spark, docs, sf_dir), name)
            assert docs.columns == make(spark).columns
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_oracles_agree(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, path).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)

        def plain(df):
            return sorted(tuple(str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else str(x) for x in r) for r in df[columns].itertuples(index=False))

        assert plain(got) == plain(want), name
