import pytest

from quire.functions import models
from quire.plans import flows
from quire.settings import DEFAULTS, Settings, merged
from quire.sources.files import scan_markdown
from quire.sources.snapshots import SnapshotStore


def counting(folder, version="1"):
    """An extractor that leaves a file for each call, and takes its worker down at a text that says so while ``folder/armed`` is there."""

    class Counting(models.RuleExtractor):
        signature = f"counting:{version}"

        def extract(self, text, title):
            import os
            import time
            import uuid

            if "poison" in text and os.path.exists(f"{folder}/armed"):
                time.sleep(6)  # the others have ended by then
                os._exit(1)
            open(f"{folder}/call-{uuid.uuid4().hex}", "w").close()
            return super().extract(text, title)

    return Counting


def calls(folder):
    found = list(folder.glob("call-*"))
    for path in found:
        path.unlink()
    return len(found)


@pytest.fixture
def place(tmp_path):
    for name in ("data", "calls"):
        (tmp_path / name).mkdir()
    for k in range(5):
        (tmp_path / "data" / f"p{k}.md").write_text(f"# A {k}\nMethod: m{k}\n\n## B\nTask: t{k}\n\n## C\nMetric: shared\n")
    return tmp_path


def run(spark, place, version="1", report=None, **settings):
    store = SnapshotStore(spark, f"file://{place}/store")
    chosen = Settings(merged(DEFAULTS, {"extraction": {"task_chunks": 1, **settings}}))
    flows.update_extractions(scan_markdown(spark, f"{place}/data"), store, counting(place / "calls", version), chosen, report)
    return store


def test_a_changed_paper_pays_for_its_changed_chunks(spark, place):
    store = run(spark, place)
    first = calls(place / "calls")
    assert store.read("extractions", flows.EXTRACTIONS).count() == 5 and first == 15
    (place / "data" / "p1.md").write_text("# A 1\nMethod: m1\n\n## B\nTask: other\n\n## C\nMetric: shared\n")
    (place / "data" / "copy.md").write_text((place / "data" / "p2.md").read_text())
    store = run(spark, place)
    # One chunk of p1; the copy has another title, of which the model is told.
    assert calls(place / "calls") == 1 + 3
    found = {r.filename: {e.name for e in r.entities} for r in store.read("extractions", flows.EXTRACTIONS).collect()}
    assert found["p1.md"] == {"m1", "other", "shared"} and found["copy.md"] == found["p2.md"]
    run(spark, place, schema_version=3)
    assert calls(place / "calls") == 18  # another schema asks anew
    store = run(spark, place, version="2", schema_version=4)
    assert calls(place / "calls") == 18  # and so does another model
    assert not store._fs.exists(store._path(flows.SPOOL)) and "todo" not in store.content()


@pytest.mark.parametrize("commit_papers", [1000, 2])
def test_a_run_that_is_killed_keeps_the_answers_of_ended_tasks(spark, place, commit_papers):
    (place / "data" / "z.md").write_text("# Z\nMethod: poison\n")
    (place / "calls" / "armed").touch()
    with pytest.raises(Exception, match="(?i)python worker|crashed|EOF|abort"):
        run(spark, place, commit_papers=commit_papers)
    assert calls(place / "calls") < 16
    kept = flows.answered(SnapshotStore(spark, f"file://{place}/store")).filter("raw IS NOT NULL").count()
    assert kept >= (8 if commit_papers == 1000 else 1)
    (place / "calls" / "armed").unlink()
    store = run(spark, place, commit_papers=commit_papers)
    assert calls(place / "calls") == 16 - kept  # no question of a task that ended is asked again
    assert store.read("extractions", flows.EXTRACTIONS).count() == 6


def test_names_of_models():
    from functools import partial

    assert models.signature(models.RuleExtractor) == "quire.functions.models:RuleExtractor"
    one, two = (models.signature(partial(models.HashEmbedder, width=w)) for w in (8, 9))
    assert one != two and one.startswith("quire.functions.models:HashEmbedder(")
    assert models.signature(counting("x", "7")) == "counting:7"


def test_a_round_reads_and_hides_what_is_its_own(spark, place, monkeypatch):
    """Answers are looked up once a run, not once a round; a question shared by rounds is put once; nothing is hidden in a first run."""
    for k in range(5):
        (place / "data" / f"p{k}.md").write_text("# A\nMethod: same\n")
    looked, gone = [], []
    known, delete = flows.answered, flows.Transaction.delete
    monkeypatch.setattr(flows, "answered", lambda store: (looked.append(1), known(store))[1])
    monkeypatch.setattr(flows.Transaction, "delete", lambda self, name, keys: (gone.append(name), delete(self, name, keys))[1])
    monkeypatch.setattr(flows.sources, "cache_miss", lambda files, *more: files.withColumn("title", flows.F.lit("one title")))
    store = run(spark, place, commit_papers=1)
    assert calls(place / "calls") == 1 and len(looked) == 1 and not gone  # no old answers: looked up once
    found = store.read("extractions", flows.EXTRACTIONS).collect()
    assert len(found) == 5 and all(e.name == "same" for r in found for e in r.entities) and all(len(r.entities) == 1 for r in found)


def test_whole_texts_meet_models_in_small_batches(spark, sf_dir, monkeypatch):
    """Points and answers come from written tables, and the tasks that write them get at most BATCH_ROWS texts at a time."""
    from quire.plans import flow_queries
    from quire.sources import scratch

    seen, kept = [], scratch.materialise
    monkeypatch.setattr(flows, "materialise", lambda df, label: seen.append(label) or kept(df, label))
    for name in ("compressed_points", "flat_answer"):
        made = flow_queries.QUERIES[name](spark, sf_dir)
        assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString(), name
    assert seen == ["points", "answers"] and scratch.BATCH_ROWS <= 1024


def test_a_round_writes_its_papers_and_nothing_else(spark, place, monkeypatch):
    """Before, each round wrote answers and failures too, and a run wrote all papers anew at every sixteenth."""
    for k in range(5, 24):
        (place / "data" / f"p{k}.md").write_text(f"# A {k}\nMethod: m{k}\n")
    written, write = [], flows.Transaction._write
    monkeypatch.setattr(flows.Transaction, "_write", lambda self, name, *more: written.append(name) or write(self, name, *more))
    told = []
    store = run(spark, place, report=lambda *x: told.append(x), commit_papers=1)
    rounds = len(told)
    assert rounds > 12 and told[-1] == (24, 24)
    assert {n: written.count(n) for n in ("extractions", "answers", "failures", "extractions.whole")} == {"extractions": rounds, "answers": 1, "failures": 0, "extractions.whole": 0}
    assert store.read("extractions", flows.EXTRACTIONS).count() == 24 and store.read("answers", models.ANSWERS).count() == 34 == calls(place / "calls")


def test_fast_calls_are_taken_in_runs_and_keep_their_places():
    def call(x):
        if x == 7:
            raise ValueError(x)
        return x

    made = models.each(call, iter(range(5000)), 8)
    assert [r for r, _ in made] == [None if x == 7 else x for x in range(5000)]
    assert [k for k, (_, e) in enumerate(made) if e is not None] == [7] and models.each(call, [], 8) == []


def test_many_parts_and_deletions_are_one_scan_each(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    for k in range(6):
        change = store.begin()
        if k:
            change.delete("t", spark.createDataFrame([(k - 1,)], "key int"))
        change.append("t", spark.createDataFrame([(k, k), (k - 1 if k % 2 else k + 100, -k)], "key int, v int"))
        change.commit()
    rows = store.read("t", "key int, v int")
    # What a version deletes is what older ones wrote, not what it writes itself.
    assert sorted(map(tuple, rows.collect())) == [(0, -1), (2, -3), (4, -5), (5, 5), (100, 0), (102, -2), (104, -4)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3


def test_papers_are_put_together_once_for_both_runs(spark, sf_dir, monkeypatch):
    """Both runs read the papers as written; before, each put them together from all line items, twice."""
    from quire.plans import flow_queries

    plans = []
    monkeypatch.setattr(flows, "update_extractions", lambda files, *_: plans.append(files._jdf.queryExecution().optimizedPlan().toString()))
    flow_queries.extraction_increment(spark, sf_dir)
    assert len(plans) == 2 and not any("Aggregate" in p or "Join" in p for p in plans)
