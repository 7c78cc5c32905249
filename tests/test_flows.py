import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import models
from quire.operators import search
from quire.plans import flows
from quire.settings import DEFAULTS, Settings, merged
from quire.sources.files import scan_markdown
from quire.sources.snapshots import SnapshotStore
from quire.streaming.watch import index_arrivals

NONE, FAILED = "nothing relevant", "failed: "
PAPER = "# {title}\nMethod: {m}\nDataset: RML\nTask: AMR\nx -USES-> {m}\n{m} -EVALUATED_ON-> RML\n{m} | Accuracy = 91.5% | SNR=10 | RML\n"


def flaky():
    class Flaky(models.RuleExtractor):  # made here, so that workers need not import this file
        def extract(self, text, title):
            if "broken" in text:
                raise RuntimeError("no reply")
            return super().extract(text, title)

    return Flaky


def write(folder, **papers):
    for name, text in papers.items():
        (folder / f"{name}.md").write_text(text)


@pytest.fixture
def library(tmp_path):
    folder = tmp_path / "md"
    folder.mkdir()
    write(folder, one=PAPER.format(title="One", m="CNN"), two=PAPER.format(title="Two", m="cnn"), three=PAPER.format(title="Three", m="LSTM"))
    return folder


def tables(store):
    return {n: sorted(map(str, store.read(n, s).collect())) for n, s in (("chunks", flows.CHUNKS), ("vectors", flows.VECTORS), ("manifest", flows.MANIFEST))}


def test_incremental_index_equals_a_rebuild(spark, library, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/index")

    def update(s):
        return flows.update_index(scan_markdown(spark, str(library)), s, models.HashEmbedder)

    assert update(store) == 1 and update(store) is None
    write(library, one="changed " * 400, four="new")
    (library / "two.md").unlink()
    assert update(store) == 2
    fresh = SnapshotStore(spark, f"file://{tmp_path}/again")
    update(fresh)
    assert tables(store) == tables(fresh)
    assert {r.filename: r.chunk_count for r in store.read("manifest", flows.MANIFEST).collect()} == {"one.md": 3, "three.md": 1, "four.md": 1}


def test_extraction_graph_retrieval_and_answer(spark, library, tmp_path):
    index, kept, graph = (SnapshotStore(spark, f"file://{tmp_path}/{n}") for n in ("i", "e", "g"))
    write(library, bad="# B\nbroken\nMethod: Q\n")
    files = scan_markdown(spark, str(library))
    flows.update_index(files, index, models.HashEmbedder)
    flows.update_extractions(files, kept, flaky())
    assert [r.error for r in kept.read("failures", "chunk_id string, filename string, error string").collect()] == ["RuntimeError: no reply"]
    assert flows.update_extractions(files, kept, models.RuleExtractor) is not None  # the failed one is tried again
    assert flows.update_extractions(files, kept, models.RuleExtractor) is None
    extractions = kept.read("extractions", flows.EXTRACTIONS)
    assert extractions.count() == 4
    chunks = index.read("chunks", flows.CHUNKS)
    for _ in range(2):
        flows.update_graph(extractions, chunks, flows.abbreviation_table(spark), graph)
    entities = graph.read("entities", flows.GRAPH_SCHEMAS["entities"])
    assert {(r.type, r.name) for r in entities.collect()} == {("Method", "Convolutional Neural Network"), ("Method", "Long Short-Term Memory"), ("Method", "Q"), ("Dataset", "RML"), ("Task", "Automatic Modulation Recognition"), ("Metric", "Accuracy")}
    edges = graph.read("edges", flows.GRAPH_SCHEMAS["edges"])
    questions = spark.createDataFrame([("q1", "LSTM Three"), ("q2", "CNN One")], "query_id string, question string")
    queries = questions.select("query_id", models.embed(questions["question"], models.HashEmbedder, True).alias("embedding"))
    keyed = entities.select(flows.graphs.entity_key(flows.F.col("name"), flows.F.col("type")).alias("entity"), "name", "type")
    found = flows.retrieve(queries, index.read("vectors", flows.VECTORS), edges.selectExpr("src_key src", "rel_type", "dst_key dst"), keyed, flows.mentions_of(edges))
    rows = found.collect()
    assert {r.query_id for r in rows} == {"q1", "q2"} and {r.source for r in rows} <= {"vector", "graph"}
    assert len({(r.query_id, r.chunk_id) for r in rows}) == len(rows)
    points = flows.answer_points(questions, found, chunks, models.LexicalReranker, lambda: models.ExtractiveGenerator(NONE), "{question} [{number}] {source}", NONE, FAILED)
    by = {(r.query_id, r.number): r for r in points.collect()}
    assert by["q1", 1].filename == "three.md" and by["q1", 1].text == "# Three"
    more = questions.union(spark.createDataFrame([("q3", "?")], questions.schema))
    made = {r.query_id: r.answer for r in flows.answers(more, points, lambda: models.ExtractiveGenerator(NONE), "answer {question}", "no source", FAILED).collect()}
    assert made["q1"].startswith("[1] source: three.md") and made["q3"] == "no source"
    flat = flows.flat_answers(questions, index.read("vectors", flows.VECTORS), chunks, models.HashEmbedder, lambda: models.ExtractiveGenerator(NONE), "{question}", FAILED, 2)
    assert {r.query_id for r in flat.collect()} == {"q1", "q2"}


def test_replies_are_validated(spark):
    rows = ['{"entities": [{"name": "A", "type": "Task"}], "relations": []}', '{"entities": [{"name": "A", "type": "Other"}], "relations": []}', "not json", '{"entities": []}', '{"entities": [], "relations": [{"head": "a", "relation": "LIKES", "tail": "b"}]}']
    df = spark.createDataFrame([(str(k), r, None) for k, r in enumerate(rows)], "chunk_id string, raw string, error string")
    got = {r.chunk_id: r for r in flows.parse_extractions(df).collect()}
    assert [got[str(k)].error is None for k in range(5)] == [True, False, False, False, False]
    assert got["0"].result.entities[0].name == "A" and got["1"].result is None


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 8)).astype(np.float32)
    rows[100:120] = rows[7]
    vectors = spark.createDataFrame([(f"v{k:03d}", r.tolist()) for k, r in enumerate(rows)] + [("none", None)], "chunk_id string, embedding array<float>").repartition(3)
    queries = vectors.filter("chunk_id < 'v020' and embedding is not null").selectExpr("chunk_id query_id", "embedding")
    for k in (1, 5, 400):
        got = {}
        for r in search.vector_topk(queries, vectors, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        for q in range(20):
            d = ((rows.astype(float) - rows[q].astype(float)) ** 2).sum(axis=1)
            assert got[f"v{q:03d}"] == [f"v{j:03d}" for j in sorted(range(300), key=lambda j: (d[j], j))[:k]]
    assert search.vector_topk(queries.limit(0), vectors, 5).collect() == []


def test_distances_are_held_in_blocks(monkeypatch):
    """Equal hits whatever number of distances a task may hold."""
    import pyarrow as pa

    from quire.functions import vectors

    rng = np.random.default_rng(6)
    rows, queries = rng.integers(0, 3, (500, 4)).astype(float), rng.integers(0, 3, (70, 4)).astype(float)
    batch = pa.RecordBatch.from_arrays([pa.array([f"k{j:03d}" for j in range(500)]), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["key", "embedding"])
    want = {}
    for q in range(70):
        d = ((rows - queries[q]) ** 2).sum(axis=1)
        want[f"q{q}"] = [(f"k{j:03d}", d[j]) for j in sorted(range(500), key=lambda j: (d[j], j))[:5]]
    for held in (1 << 22, 1500, 1):
        monkeypatch.setattr(vectors, "DISTANCES", held)
        got = {}
        for made in vectors.nearest(iter([batch.slice(0, 200), batch.slice(200)]), [f"q{q}" for q in range(70)], queries, 5):
            for q, key, d in zip(*(c.to_pylist() for c in made.columns)):
                got.setdefault(q, []).append((key, d))
        assert got == want


def test_shared_words_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, sorted(set(rng.choice(words, rng.integers(0, 12))))) for k in range(200)] + [(900, None)]
    queries = [(k, sorted(set(rng.choice(words, rng.integers(0, 6))))) for k in range(20)]
    frames = [spark.createDataFrame([(k, None if w is None else [str(x) for x in w]) for k, w in rows], f"{name} long, words array<string>") for rows, name in ((queries, "query_id"), (docs, "key"))]
    for held in (1 << 25, 500):
        monkeypatch.setattr(search, "QUERY_BYTES", held)
        got = {}
        for r in search.lexical_topk(frames[0], frames[1].repartition(3), 7).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.key, r.score))
        for q, wanted in queries:
            scores = [(k, len(set(w or ()) & set(wanted)) / max(1, len(wanted))) for k, w in docs]
            assert got.get(q, []) == sorted([x for x in scores if x[1] > 0], key=lambda x: (-x[1], x[0]))[:7]


def test_queries_run_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    vectors = spark.createDataFrame([(f"v{k}", [float(k), 0.0]) for k in range(30)], "chunk_id string, embedding array<float>")
    rows = search.vector_topk(vectors.selectExpr("chunk_id query_id", "embedding"), vectors, 1).collect()
    assert sorted((r.query_id, r.chunk_id) for r in rows) == sorted((f"v{k}", f"v{k}") for k in range(30))


def test_last_token_pool():
    states = np.arange(12.0).reshape(2, 3, 2)
    assert models.last_token_pool(states, np.array([[1, 1, 1], [1, 1, 0]])).tolist() == [[4, 5], [8, 9]]
    assert models.last_token_pool(states, np.array([[0, 1, 1], [1, 1, 1]])).tolist() == [[4, 5], [10, 11]]


def test_stream_indexes_what_arrives(spark, library, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/stream")

    def update(files):
        return flows.update_index(files, store, models.HashEmbedder)

    for text in (None, "later"):
        if text:
            write(library, later=text)
        query = index_arrivals(spark, str(library), f"file://{tmp_path}/cp", update)
        query.awaitTermination(60)
        assert query.exception() is None
    assert store.versions() == [1, 2] and store.read("manifest", flows.MANIFEST).count() == 4


def test_answer_flow_reads_the_end_of_long_documents(spark, tmp_path):
    """A passage after word 2,048 is found, and is the point that the answer cites."""
    from quire.plans.queries import answer_flow

    filler = "\n".join(" ".join(f"f{k}w{j}" for j in range(12)) for k in range(300))
    passage = "zebra quartz violin harbour lantern meadow copper thistle orchard falcon"
    docs = [(1, filler + "\n## Late\n" + passage + "\n## Later\n" + filler.replace("f", "g"), "en", "s", 1)] + [(k, f"other text number {k} of the small ones", "en", "s", 1) for k in range(2, 12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    [row] = answer_flow(spark, str(tmp_path)).collect()
    assert row.query_id == "7" and row.answer == "[1] source: d_1.md"


def test_answer_flow_reads_chunks_of_many_short_words(spark, tmp_path):
    from quire.plans.queries import answer_flow

    passage = "zebra quartz violin harbour"
    docs = [(1, "a b " * 300 + passage, "en", "s", 1), (2, "zebra quartz", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.answer for r in answer_flow(spark, str(tmp_path)).collect()] == ["[1] source: d_1.md"]


def test_a_run_that_stops_keeps_its_commits(spark, library, tmp_path, monkeypatch):
    """A failure after some commits, or between two writes of one, leaves the papers of the commits and hides none."""
    store, settings = SnapshotStore(spark, f"file://{tmp_path}/e"), Settings(merged(DEFAULTS, {"extraction": {"commit_papers": 1}}))
    files = scan_markdown(spark, str(library))
    flows.update_extractions(files.filter("filename = 'one.md'"), store, models.RuleExtractor, settings)

    def stop(done, of):
        raise KeyboardInterrupt

    write(library, four="# F\nMethod: X\n", five="# G\nMethod: Y\n")
    files = scan_markdown(spark, str(library))
    with pytest.raises(KeyboardInterrupt):
        flows.update_extractions(files, store, models.RuleExtractor, settings, stop)
    kept = {r.filename for r in store.read("extractions", flows.EXTRACTIONS).collect()}
    assert "one.md" in kept and 1 < len(kept) < 5
    with monkeypatch.context() as m:
        m.setattr(flows, "parse_extractions", lambda _: 1 / 0)  # after the replies are written
        with pytest.raises(ZeroDivisionError):
            flows.update_extractions(files, store, models.RuleExtractor, settings)
    assert {r.filename for r in store.read("extractions", flows.EXTRACTIONS).collect()} == kept
    told = []
    flows.update_extractions(files, store, models.RuleExtractor, settings, lambda *x: told.append(x))
    assert told[-1] == (5 - len(kept), 5 - len(kept))
    assert {r.filename for r in store.read("extractions", flows.EXTRACTIONS).collect()} == {f"{n}.md" for n in ("one", "two", "three", "four", "five")}


def test_only_new_chunks_are_written(spark, library, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/index")

    def update():
        return flows.update_index(scan_markdown(spark, str(library)), store, models.HashEmbedder)

    update()
    first = store.content()["chunks"]
    write(library, four="new")
    (library / "two.md").unlink()
    update()
    entries = store.content()["chunks"]
    assert entries[0] == first[0] and [sorted(e) for e in entries] == [["at", "rows"], ["at", "gone", "key"], ["at", "rows"]]
    assert spark.read.parquet(f"{store.root}/{entries[2]['rows']}").count() == 1
    for k in range(8):
        write(library, four=f"again {k}")
        update()
    assert len(store.content()["chunks"]) <= 17
    store.expire(1)
    assert len(store.versions()) == 1
    assert sorted(r.chunk_id for r in store.read("chunks", flows.CHUNKS).collect()) == ["four.md::0", "one.md::0", "three.md::0"]
    assert sorted(r.chunk_id for r in store.read("vectors", flows.VECTORS).collect()) == ["four.md::0", "one.md::0", "three.md::0"]


def test_keys_are_checked_before_a_version_is_seen(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, f"file://{tmp_path}/g")
    twice = spark.createDataFrame([("a", "t"), ("a", "t")], flows.GRAPH_SCHEMAS["papers"])
    none = {n: spark.createDataFrame([], s) for n, s in flows.GRAPH_SCHEMAS.items()}
    monkeypatch.setattr(flows.graphs, "build", lambda *_: flows.graphs.Graph(**(none | {"papers": twice})))
    with pytest.raises(ValueError, match="not unique"):
        flows.update_graph(twice, twice, twice, store)
    assert store.versions() == []


def test_repeats_are_counted_before_they_are_dropped(spark):
    raw = '{"entities": [{"name": "A", "type": "Task"}, {"name": " A", "type": "Task"}], "relations": [], "performances": [%s]}' % ", ".join(['{"method": "m", "metric": "x", "value": "1"}'] * 3)
    rows = spark.createDataFrame([("f::0", "f", 0, raw, None)], "chunk_id string, filename string, index int, raw string, error string")
    files = spark.createDataFrame([("f", "h", "t"), ("g", "h", "t")], "filename string, text_md5 string, title string")
    papers = {r.filename: r for r in flows.papers_of(flows.parse_extractions(rows), files, 2).collect()}
    assert (len(papers["f"].mentions), papers["f"].n_mentions, len(papers["f"].performances), papers["f"].n_performances) == (1, 2, 1, 3)
    assert papers["g"].mentions == [] and papers["g"].n_mentions == 0


def test_models_are_built_once_and_called_side_by_side(spark, tmp_path):
    class Slow(models.RuleExtractor):
        def __init__(self):
            (tmp_path / f"built-{np.random.default_rng().integers(1 << 40)}").touch()

        def extract(self, text, title):
            import threading
            import time

            (tmp_path / f"thread-{threading.get_ident()}").touch()
            time.sleep(0.05)
            return super().extract(text, title)

    rows = spark.createDataFrame([(f"f::{k}", "f", k, "t", "Method: A") for k in range(12)], "chunk_id string, filename string, index int, title string, text string").repartition(1)
    for _ in range(12):
        made = models.extract(rows, Slow, 4).collect()
        assert len(made) == 12 and all(r.chunk_id == f"f::{r['index']}" and "A" in r.raw for r in made)
    assert len(list(tmp_path.glob("built-*"))) < 12
    assert len(list(tmp_path.glob("thread-*"))) > 1


def onnx_gather(table):
    """A model in ONNX form, spelled out: the rows of a table by input_ids."""

    def number(n):
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    def field(k, x):
        return number(k << 3) + number(x) if isinstance(x, int) else number(k << 3 | 2) + number(len(x)) + x

    def value(name, kind, dims):
        shape = b"".join(field(1, field(2, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    node = field(1, b"table") + field(1, b"input_ids") + field(2, b"states") + field(4, b"Gather")
    weights = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, b"table") + field(9, table.astype("<f4").tobytes())
    graph = field(1, node) + field(2, b"g") + field(5, weights) + field(11, value(b"input_ids", 7, [b"n", b"t"])) + field(12, value(b"states", 1, [b"n", b"t", b"d"]))
    return field(1, 8) + field(7, graph) + field(8, field(2, 13))


def test_transformers_in_onnx_form(tmp_path):
    pytest.importorskip("onnxruntime")
    from tokenizers import Tokenizer, models as parts, pre_tokenizers

    from quire.functions.transformer import embedder_of, reranker_of

    words = {w: k for k, w in enumerate(["[PAD]", "[UNK]", "ask", "a", "b", "c"])}
    own = Tokenizer(parts.WordLevel(words, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "tokenizer.json"))
    table = np.arange(18.0).reshape(6, 3)
    (tmp_path / "model.onnx").write_bytes(onnx_gather(table))
    settings = Settings({"embedding": {"model": str(tmp_path), "instruction": "ask "}, "rerank": {"model": str(tmp_path), "max_length": 2}})
    embedder = embedder_of(settings)()
    assert embedder.embed(["a b c", "a"], False).tolist() == [table[5].tolist(), table[3].tolist()]  # the last token of each, padded or not
    assert embedder.embed(["ask"], False).tolist() == [table[2].tolist()]
    reranker = reranker_of(settings)()
    assert reranker.score([("a", "b"), ("b", "c")]) == [table[3][0], table[4][0]]
    assert embedder_of(Settings()) is None and reranker_of(Settings()) is None


def test_listings_are_compared_once(spark, tmp_path, monkeypatch):
    """An index run reads its difference as written; before, each of its steps compared all files again."""
    compared, diff = spark.sparkContext.accumulator(0), flows.sources.manifest_diff

    def counted(manifest, listing):
        found = diff(manifest, listing)

        def passed(batches):
            for batch in batches:
                compared.add(batch.num_rows)
                yield batch

        return found.mapInArrow(passed, found.schema)

    monkeypatch.setattr(flows.sources, "manifest_diff", counted)
    name = F.concat(F.lit("f"), "id", F.lit(".md"))
    files = spark.range(30).select(name.alias("filename"), F.lit("t").alias("title"), F.concat(F.lit("text "), "id").alias("text"), F.md5(name.cast("binary")).alias("md5"))
    store = SnapshotStore(spark, f"file://{tmp_path}/index")
    flows.update_index(files, store, models.HashEmbedder)
    assert compared.value == 30
    assert flows.update_index(files, store, models.HashEmbedder) is None
    assert store.read("chunks", flows.CHUNKS).count() == 30
