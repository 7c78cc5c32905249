"""The stages end to end: index, extraction, graph, retrieval, answers. Each is a function of DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions import models
from quire.functions.chunking import chunk_files
from quire.functions.text import strip
from quire.operators import graph as graphs
from quire.operators import resolve, search, select, traverse
from quire.schemas import CHUNKS, ENTITY_TYPES, EXTRACTION, EXTRACTIONS, MANIFEST, RELATION_ENDS, VECTORS
from quire.settings import Settings
from quire.sources import files as sources
from quire.sources.scratch import materialise
from quire.sources.snapshots import PARTS, SnapshotStore, Transaction, assert_unique

GRAPH_SCHEMAS = {
    "papers": "filename string, title string",
    "entities": "name string, type string",
    "chunks": "chunk_id string, filename string, index int, text string",
    "results": "result_id string, metric string, value string, value_num double, condition string, dataset string",
    "edges": "src_label string, src_key string, rel_type string, dst_label string, dst_key string",
}


def update_index(files: DataFrame, store: SnapshotStore, embedder: Callable[[], models.Embedder], settings: Settings | None = None) -> int | None:
    """Bring chunks, vectors and manifest up to the listing in one commit; None if nothing changed.

    Only new and modified files are split and embedded, once, and appended; the chunks of removed and modified ones are deleted by
    the ids that the old manifest counts. What is unchanged stays where it is.
    """
    manifest = store.read("manifest", MANIFEST)
    change = store.begin()
    diff = change.spool("diff", sources.manifest_diff(manifest, files).filter("status <> 'unchanged'"))
    if diff.isEmpty():
        change.drop_spools()
        return None
    times = files.select("filename", *(F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("length", "long"), ("modified", "timestamp"))))
    return _commit_index(manifest, diff, files, times, store, embedder, settings or Settings(), change)


def update_index_folder(spark: SparkSession, folder: str, store: SnapshotStore, embedder: Callable[[], models.Embedder], settings: Settings | None = None) -> int | None:
    """update_index() of a folder, of whose files only those are read that are new, or whose size or time of change is another.

    A file that was written again with the same bytes is read once more and then remembered by its new time. A change that keeps both
    size and time isn't seen; a manifest without them sees every file.
    """
    manifest = store.read("manifest", MANIFEST)
    listing = sources.list_markdown(spark, folder)
    change = store.begin()
    change.replace("listing", listing)
    listing = change.read("listing", "filename string, path string, length bigint, modified timestamp")
    looked = sources.to_look_at(manifest, listing)
    files = sources.read_files(spark, folder, looked)
    same = manifest.select("filename", "md5").join(listing.select("filename"), "filename", "left_semi").join(looked.select("filename"), "filename", "left_anti")
    change.replace("digests", files.select("filename", "md5").unionByName(same))
    diff = change.spool("diff", sources.manifest_diff(manifest, change.read("digests", "filename string, md5 string")).filter("status <> 'unchanged'"))
    times = listing.select("filename", "length", "modified")
    if diff.isEmpty():
        if looked.isEmpty():
            change.drop_spools()
            return None
        change.tables = store.content()
        change.replace("manifest", manifest.drop("length", "modified").join(times, "filename"))
        change.commit()
        return None
    return _commit_index(manifest, diff, files, times, store, embedder, settings or Settings(), change)


def _commit_index(manifest: DataFrame, diff: DataFrame, files: DataFrame, times: DataFrame, store: SnapshotStore, embedder: Callable[[], models.Embedder], settings: Settings, change: Transaction) -> int:
    """diff: the changed files alone, written, as every step reads it."""
    for name in ("listing", "digests"):
        change.tables.pop(name, None)
    changed = diff.select("filename")
    gone = sources.deleted_chunk_ids(diff).select("chunk_id")
    change.delete("chunks", gone)
    change.delete("vectors", gone)
    fresh = change.append("chunks", chunk_files(files.join(sources.to_add(diff).select("filename"), "filename", "left_semi"), settings))
    change.append("vectors", fresh.select("chunk_id", models.embed(F.col("text"), embedder, batch=settings.get("embedding.batch_size", 16)).alias("embedding")))
    counts = fresh.groupBy("filename").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    added = sources.to_add(diff).select("filename", "md5").join(counts, "filename", "left").select("filename", "md5", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    kept = manifest.join(changed, "filename", "left_anti").select("filename", "md5", "chunk_count")
    change.replace("manifest", kept.unionByName(added).join(times, "filename", "left").select("filename", "md5", "chunk_count", "length", "modified"))
    change.compact("chunks", CHUNKS)
    change.compact("vectors", VECTORS)
    return change.commit()


def import_extractions(papers: DataFrame, store: SnapshotStore) -> int:
    """Take in extractions that were kept elsewhere (EXTRACTIONS rows, one a paper), in place of those of the same papers."""
    change = store.begin()
    change.replace("incoming", papers)
    papers = change.read("incoming", EXTRACTIONS)
    del change.tables["incoming"]
    assert_unique(papers, ["filename"])
    for name in ("extractions", "failures"):
        change.delete(name, papers.select("filename"))
    change.append("extractions", papers)
    change.compact("extractions", EXTRACTIONS)
    return change.commit()


#: Whether a parsed reply is an extraction. SQL, as it is put together once a round, and text costs one call of the JVM.
_VALID = f"""coalesce(result.entities IS NOT NULL AND result.relations IS NOT NULL
    AND forall(result.entities, e -> e.type IN ({", ".join(map(repr, ENTITY_TYPES))}) AND e.name IS NOT NULL)
    AND forall(result.relations, r -> r.relation IN ({", ".join(map(repr, RELATION_ENDS))}) AND r.head IS NOT NULL AND r.tail IS NOT NULL), false)"""


def parse_extractions(raw: DataFrame) -> DataFrame:
    """raw (chunk_id, filename, index, raw, error) with ``result``, null and an error where a reply is no valid extraction.

    A reply must be JSON with entities and relations of the closed kinds; performances may be missing.
    """
    parsed = raw.withColumn("result", F.from_json("raw", EXTRACTION))
    return parsed.withColumns({"error": F.expr(f"CASE WHEN error IS NULL AND NOT {_VALID} THEN 'invalid reply' ELSE error END"), "result": F.expr(f"CASE WHEN error IS NULL AND {_VALID} THEN result END")})


PERFORMANCE_FIELDS = ("method", "metric", "value", "condition", "dataset")


def papers_of(parsed: DataFrame, files: DataFrame, schema_version: int) -> DataFrame:
    """One row per file: distinct entities, relations, mentions and results of its chunks, each list in a total order.

    The lists of a chunk meet in one aggregation per file, and a paper's lists are as long as the paper. n_mentions and n_performances
    count what the chunks said, before repeats were dropped.
    """
    return _papers_of(parsed, files, schema_version, _lists()).drop("n_failed")


def _lists() -> tuple[list[Column], list[Column], list[Column]]:
    """The columns of papers_of(): of a chunk, of a file's chunks together, and of a paper. A run makes them once, as each is hundreds of calls of the JVM."""
    index = F.col("index").alias("chunk_index")
    own = [
        F.transform("result.entities", lambda e: F.struct(e["type"].alias("type"), strip(e["name"]).alias("name"))).alias("entities"),
        F.transform("result.relations", lambda r: F.struct(strip(r["head"]).alias("head"), r["relation"].alias("relation"), strip(r["tail"]).alias("tail"))).alias("relations"),
        F.transform(F.coalesce("result.performances", F.array()), lambda p: F.struct(index, *[strip(F.coalesce(p[n], F.lit(""))).alias(n) for n in PERFORMANCE_FIELDS])).alias("performances"),
        F.transform("result.entities", lambda e: F.struct(index, e["type"].alias("type"), strip(e["name"]).alias("name"))).alias("mentions"),
    ]
    names = ("entities", "relations", "performances", "mentions")
    met = [*[F.flatten(F.collect_list(n)).alias(n) for n in names], F.count("error").alias("n_failed")]
    every = {n: F.coalesce(F.col(n), F.array()) for n in names}
    whole = [*[F.sort_array(F.array_distinct(x)).alias(n) for n, x in every.items()], *[F.size(every[n]).alias(f"n_{n}") for n in ("mentions", "performances")], F.col("n_failed")]
    return own, met, whole


def _papers_of(parsed: DataFrame, files: DataFrame, schema_version: int, lists: tuple[list[Column], list[Column], list[Column]]) -> DataFrame:
    """papers_of() with ``n_failed``, the number of chunks of the file that have an error."""
    own, met, whole = lists
    papers = files.select("filename", F.col("text_md5").alias("content_hash"), "title", F.lit(schema_version).alias("schema_version"))
    papers = papers.join(parsed.select("filename", *own, "error").groupBy("filename").agg(*met).hint("merge"), "filename", "left")
    return papers.select("filename", "content_hash", "title", "schema_version", *whole)


FAILURES = "chunk_id string, filename string, error string"
#: Commits of one run at most, however many papers it has.
COMMITS = 64
#: Tasks that put the questions of a round at most; a round of common size has fewer.
TASKS = 512
#: Folder beside the versions in which answers lie from the end of the task that got them until a version takes them in.
SPOOL = "spool"
#: What a run has to do, by folder: p1 are the papers of round 1, q1 the questions that it puts, each beside the chunk that puts it, and
#: s1 the chunks of any round whose questions are among q1; those of s-1 were answered before the run.
WORK = "filename string, title string, text_md5 string, old int, chunk_id string, index int, text string, digest string, turn int"
#: Chunks of a folder of WORK that one task writes, about; papers that one task splits, and replies that one task reads, at most.
SLICE, SPLIT, READ = 100_000, 10_000, 5_000
#: Numbers of chunks within a round, by a hash.
_PLACES = 40


def _spooled(store: SnapshotStore, folder: str = "") -> DataFrame:
    """Answers that no version has taken in, or those of one folder of them."""
    path = f"{SPOOL}/{folder}".rstrip("/")
    if not store._fs.exists(store._path(path)):
        return store.spark.createDataFrame([], models.SPOOLED)
    return store.spark.read.schema(models.SPOOLED).option("recursiveFileLookup", "true").parquet(f"{store.root}/{path}")


def _every_answer(store: SnapshotStore) -> DataFrame:
    spooled = _spooled(store)
    return store.read("answers", models.ANSWERS).unionByName(spooled.select("digest", "at", "raw", "error"))


def answered(store: SnapshotStore) -> DataFrame:
    """digest, raw, error: the answer to each question that was ever asked, from the versions and from runs that stopped; else its last error."""
    return _latest(_every_answer(store))


def _latest(answers: DataFrame) -> DataFrame:
    return answers.groupBy("digest").agg(F.max("raw").alias("raw"), F.max_by("error", "at").alias("error"))


def ask(questions: DataFrame, count: int, store: SnapshotStore, folder: str, extractor: Callable[[], models.Extractor], at: int, workers: int, task_chunks: int) -> None:
    """Put ``count`` distinct questions (WORK). A task that ends leaves its answers for good, whatever becomes of the job.

    Tasks have about ``task_chunks`` questions, more if there were more than TASKS tasks, and their files are moved into the spool one
    by one as they end (the second algorithm of Hadoop's committer). A task that runs twice may leave an answer twice, which
    answered() takes as one.
    """
    tasks = min(max(1, -(-count // task_chunks)), TASKS)
    dealt = questions.coalesce(1) if tasks == 1 else questions.repartition(tasks)
    made = models.answer(dealt, extractor, at, workers)
    made.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{store.root}/{SPOOL}/{folder}")


def _deal(files: DataFrame, store: SnapshotStore, change: Transaction, model: str, settings: Settings) -> tuple[int, int, dict[str, tuple[int, int]]]:
    """Write WORK of the papers that the kept extractions lack, as table ``work``: number of papers and of rounds; rows of each folder, and of all ``chunks``, and how many of them are old.

    Old papers are those of which the store has rows that a commit must hide. Papers are split, and their questions looked up among the
    answers, once for all rounds; only questions that several chunks share or that were answered before meet their chunks again.
    """
    version, size = settings.get("extraction.schema_version", 1), settings.get("extraction.commit_papers", 1000)
    failed = store.read("failures", FAILURES).select("filename").distinct()
    held = store.read("extractions", EXTRACTIONS)
    todo = sources.cache_miss(files, held.join(failed, "filename", "left_anti"), version)
    todo = change.spool("todo", todo.select("filename", "title", "text", "text_md5"))
    count = todo.count()
    if not count:
        return 0, 0, {}
    rounds = max(1, min(COMMITS, -(-count // size)))
    turn = F.pmod(F.xxhash64("filename"), F.lit(rounds)).cast("int")
    place = F.shiftleft(turn.cast("long"), _PLACES) + F.pmod(F.xxhash64("chunk_id"), F.lit(1 << _PLACES))
    if todo.rdd.getNumPartitions() < (tasks := -(-count // SPLIT)):
        todo = todo.repartition(tasks)  # small texts are few bytes, but much to split
    chunks = chunk_files(todo, settings).withColumn("text", strip(F.col("text"))).filter("text <> ''")
    chunks = models.asked(chunks.select("chunk_id", "filename", F.col("index").cast("int").alias("index"), "title", "text"), model, version)
    chunks = change.spool("chunks", chunks.withColumns({"place": place, "turn": turn}))
    known = _every_answer(store).filter("raw IS NOT NULL").select("digest", F.lit(-1 << _PLACES).alias("known")).distinct()
    shared = chunks.select("digest", "place").repartition("digest").groupBy("digest").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    shared = shared.join(known, "digest", "left").filter("n > 1 OR known IS NOT NULL")
    shared = change.spool("shared", shared.select("digest", F.coalesce("known", "least").alias("first")))
    puts = F.col("first").isNull() | (F.col("first") == F.col("place"))
    folder = F.when(puts, F.concat(F.lit("q"), "turn")).otherwise(F.concat(F.lit("s"), F.shiftright("first", _PLACES).cast("string")))
    asked = [F.when(puts, F.col(n)).alias(n) for n in ("title", "text")]
    work = chunks.join(shared, "digest", "left").select("filename", *asked, "chunk_id", "index", "digest", "turn", folder.alias("folder"))
    old = held.select("filename").unionByName(failed).distinct().withColumn("old", F.lit(1))
    papers = todo.select("filename", "title", "text_md5", F.concat(F.lit("p"), turn).alias("folder")).join(old, "filename", "left")
    many = chunks.count()
    slices = max(1, -(-many // (rounds * SLICE)))
    work = work.unionByName(papers, allowMissingColumns=True).repartition("folder", F.pmod(F.xxhash64("filename"), F.lit(slices)))
    change.replace("work", work, ["folder"])
    sizes = change.read("work", f"{WORK}, folder string").groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.count("old").alias("old"))
    return count, rounds, {r["folder"]: (r["n"], r["old"]) for r in sizes.collect()} | {"chunks": (many, 0)}  # three rows a round


def update_extractions(files: DataFrame, store: SnapshotStore, extractor: Callable[[], models.Extractor], settings: Settings | None = None, report: Callable[[int, int], None] | None = None) -> int | None:
    """Extract what the kept extractions lack, and commit about every ``extraction.commit_papers`` papers.

    A run that stops keeps the papers of its commits and every answer of a task that ended; the next one asks for the rest alone, and
    of a changed paper only for chunks that no paper had. Failed chunks are kept by their error and tried again next time. ``report``
    is told how many papers of how many are done after each commit.

    A question that several papers share is put in the first of their rounds, and its answer is then laid out for the others; an
    answer to a question of one chunk lies beside the name of that chunk, so that a round reads what is its own and joins nothing.
    The answers go from the spool into the version of the last round.
    """
    settings = settings or Settings()
    version, change = settings.get("extraction.schema_version", 1), store.begin()
    count, rounds, sizes = _deal(files, store, change, models.signature(extractor), settings)
    if not count:
        change.drop_spools()
        return None
    old_answers = answered(store)
    [place] = [e["rows"] for e in change.tables["work"]]
    laid, run = f"{place}.replies", uuid.uuid4().hex

    def work(kind: str, number: int) -> DataFrame:
        return store.spark.read.schema(WORK).parquet(f"{store.root}/{place}/folder={kind}{number}")

    def lay_out(own: DataFrame, answers: DataFrame) -> None:
        """Join chunks with the answers to their questions, for the rounds of the papers that they are of."""
        replies = own.select("digest", "chunk_id", "filename", "index", "turn").join(answers.join(own.select("digest"), "digest", "left_semi"), "digest")
        replies.drop("digest").repartition("turn").write.mode("append").partitionBy("turn").parquet(f"{store.root}/{laid}")

    if "s-1" in sizes:
        lay_out(work("s", -1), old_answers)
    change.tables["replies"] = [{"at": change.version, "rows": laid}]
    if rounds > 1:
        change.commit()
    first = change.version + (rounds > 1)
    numbers = [n for n in range(rounds) if f"p{n}" in sizes]
    lists, columns = _lists(), ("chunk_id", "filename", "index", "raw", "error")

    def put(at: int) -> None:
        """Put the questions of a round, and lay out what others share."""
        number = numbers[at]
        if f"q{number}" in sizes:
            ask(work("q", number), sizes[f"q{number}"][0], store, f"{run}-{number}", extractor, first + at, settings.get("extraction.max_workers", 8), settings.get("extraction.task_chunks", 32))
            if f"s{number}" in sizes:
                lay_out(work("s", number), _latest(_spooled(store, f"{run}-{number}")))

    def replies_of(number: int) -> DataFrame:
        found = [_spooled(store, f"{run}-{number}")] if f"q{number}" in sizes else []
        if store._fs.exists(store._path(own := f"{laid}/turn={number}")):
            found.append(store.spark.read.schema(models.REPLIES).parquet(f"{store.root}/{own}"))
        return reduce(DataFrame.unionByName, [r.select(*columns) for r in found or [store.spark.createDataFrame([], models.REPLIES)]])

    done = last = 0
    with ThreadPoolExecutor(1) as pool:  # the model is asked for the next round while one is read and committed
        running = pool.submit(put, 0)
        for at, number in enumerate(numbers):
            running.result()
            if rounds > 1:
                change = store.begin()
            replies, own, (many, stale) = replies_of(number), work("p", number), sizes[f"p{number}"]
            if at + 1 < len(numbers):
                running = pool.submit(put, at + 1)
            # Of papers and chunks of a round as one task reads; more are dealt out by paper.
            tasks = -(-max(many, sizes["chunks"][0] // rounds) // READ)
            papers, replies = (df.coalesce(1) if tasks == 1 else df.repartition(tasks, "filename") for df in (own, replies))
            parsed = parse_extractions(_once(replies))
            if stale:
                change.delete_from(("extractions", "failures"), own.filter("old = 1").select("filename"))
            seen = Observation(f"papers-{number}")
            made = _papers_of(parsed, papers, version, lists).observe(seen, F.coalesce(F.sum("n_failed"), F.lit(0)).alias("n_failed"))
            change.append("extractions", made.drop("n_failed"))
            if seen.get["n_failed"]:
                change.append("failures", parsed.filter(F.col("error").isNotNull()).select("chunk_id", "filename", "error"))
            done += many
            if at + 1 == len(numbers):
                change.append("answers", _spooled(store).select("digest", "at", "raw", "error"))
                # A run of many rounds has many parts, which are written anew once, and not while they come.
                for name, schema in (("extractions", EXTRACTIONS), ("failures", FAILURES), ("answers", models.ANSWERS)):
                    change.compact(name, schema, PARTS + (COMMITS if name == "extractions" else 0))
                for name in ("work", "replies"):
                    change.tables.pop(name, None)
            last = change.commit()
            if report:
                report(done, count)
    store._fs.delete(store._path(SPOOL), True)  # a version has taken them in
    return last


def _once(replies: DataFrame) -> DataFrame:
    """One reply a chunk, as a task that ran twice may have left two. Replies lie in tasks by paper, so that none is shuffled here or in papers_of()."""
    best = replies.groupBy("filename", "chunk_id", "index").agg(F.max("raw").alias("raw"), F.max("error").alias("error"))
    return best.withColumn("error", F.when(F.col("raw").isNull(), F.col("error")))


def update_graph(extractions: DataFrame, chunks: DataFrame, abbreviations: DataFrame, store: SnapshotStore, reset: bool = False, prune: bool = False, totals: dict[str, int] | None = None, report: Callable[[str, int], None] | None = None) -> int:
    """Build the graph and commit it over the old one, or in its place; keys are checked before the version can be seen.

    ``totals`` gets what the build took in, observed by Spark while the tables are written: papers, mentions, relations and results of the
    extractions, and the rows of each table. ``report`` is told of each table and its rows as it is done.

    Nodes and edges lie in buckets by their keys, and only buckets with a change are written. ``prune`` takes out what the build no longer
    makes, so that stale results and names go; without it nothing is deleted.
    """
    change = store.begin()

    def keep(name: str, df: DataFrame) -> DataFrame:
        change.replace(name, df)
        return change.read(name, df.schema)

    new = graphs.build(extractions, chunks, abbreviations, keep)
    for name, key in {**graphs.NODE_KEYS, "edges": graphs.EDGE_KEY}.items():
        if reset:
            change.tables.pop(name, None)
        seen = Observation(name)
        counts = [F.count(F.lit(1)).alias("rows")]
        rows = getattr(new, name)
        if name == "papers" and totals is not None:
            taken = Observation("extractions")
            rows = graphs.papers_of(extractions.select("filename", "title", "mentions", "relations", "performances").observe(taken, *graphs.taken_in()))
        rows = rows.observe(seen, *counts)
        gone = None
        if prune and not reset:
            rows = keep(f"{name}.built", rows)
            gone = store.read(name, GRAPH_SCHEMAS[name]).select(*key).join(rows.select(*key), key, "left_anti")
        change.merge(name, rows, key, gone)
        change.tables.pop(f"{name}.built", None)
        if totals is not None:
            totals.update((taken.get if name == "papers" else {}) | {f"{name}_rows": seen.get["rows"]})
        if report:
            report(name, seen.get["rows"])
    return change.commit()


def mentions_of(edges: DataFrame) -> DataFrame:
    return edges.filter("rel_type = 'MENTIONED_IN'").select(F.col("src_key").alias("entity"), F.col("dst_key").alias("chunk_id"))


def retrieve(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entities: DataFrame, mentions: DataFrame, settings: Settings | None = None) -> DataFrame:
    """query_id, chunk_id, source, merged_pos, score, hop, n_seeds, entity of the merged chunks of every query; texts are joined by the caller, last.

    queries: query_id, embedding; edges: src, rel_type, dst; entities: entity, name, type; mentions: entity, chunk_id.
    """
    return select.merge_dedup(*retrieve_parts(queries, vectors, edges, entities, mentions, settings))


def retrieve_parts(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entities: DataFrame, mentions: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """What retrieve() merges: the rows of the vector search and those of the graph, which may share chunks."""
    get = (settings or Settings()).get
    hits = traverse.written("hits", search.vector_topk(queries, vectors, get("retrieval.k", 5)))  # read by the seeds and by the merge
    seeds = traverse.seed_entities(hits, mentions)
    expanded = traverse.expand_entities(seeds, edges, entities, get("retrieval.hops", 2), get("retrieval.relation_types", []), get("retrieval.max_entities", 40))
    quota, cap = get("retrieval.max_per_entity", 3), get("retrieval.max_chunks", 20)
    expanded = traverse.written("expanded", expanded)
    posted = traverse.written("postings", traverse.postings(mentions, select.needed(quota, cap)))
    chosen = select.greedy(traverse.posted_chunks(expanded, posted, limits=(quota, cap)), quota, cap)
    graph = chosen.join(expanded.select("query_id", "rank", "hop", "n_seeds", F.col("name").alias("entity")), ["query_id", "rank"]).drop("rank")
    return hits.select("query_id", "chunk_id", F.col("rank").alias("position"), "score"), graph


def answer_points(questions: DataFrame, found: DataFrame, chunks: DataFrame, reranker: Callable[[], models.Reranker], compressor: Callable[[], models.Generator], prompt: str, marker: str, failure: str, top_n: int = 10, settings: Settings | None = None) -> DataFrame:
    """query_id, number, chunk_id, filename, text: the compressed, relevant points of each question, cited 1..n.

    questions: query_id, question; found: the output of retrieve; chunks: chunk_id, filename, text.
    ``prompt`` names {question}, {number}, {source} and ends with the text after a line of dashes. The points are written once, as that
    hands whole texts to the models in small batches (see materialise).
    """
    get = (settings or Settings()).get
    rows = found.join(chunks.select("chunk_id", "filename", "text"), "chunk_id").join(questions, "query_id")
    scored = rows.withColumn("rerank_score", models.rerank_score(F.col("question"), F.col("text"), reranker, get("rerank.batch_size", 32)))
    top = select.rank_by_score(scored, top_n)
    asked = F.lit(prompt)
    for name, value in (("question", F.col("question")), ("number", F.col("rank").cast("string")), ("source", F.col("filename"))):
        asked = F.replace(asked, F.lit("{" + name + "}"), value)
    pointed = top.withColumn("text", models.generate(F.concat(asked, F.lit("\n---\n"), F.col("text")), compressor, failure, get("compression.max_workers", 4)))
    kept = select.renumber(pointed.filter(select.is_relevant(F.col("text"), marker, failure)))
    return materialise(kept.select("query_id", "number", "chunk_id", "filename", "text"), "points")


def answers(questions: DataFrame, points: DataFrame, generator: Callable[[], models.Generator], prompt: str, nothing: str, failure: str) -> DataFrame:
    """query_id, answer for every question; one without points gets the message ``nothing``."""
    cited = select.cited_points(points)
    rows = questions.join(cited, "query_id", "left")
    asked = F.concat(F.replace(F.lit(prompt), F.lit("{question}"), F.col("question")), F.lit("\n---\n"), F.coalesce("points", F.lit("")))
    made = rows.withColumn("made", models.generate(asked, generator, failure))
    return made.select("query_id", F.when(F.col("points").isNull(), F.lit(nothing)).otherwise(F.col("made")).alias("answer"))


def flat_answers(questions: DataFrame, vectors: DataFrame, chunks: DataFrame, embedder: Callable[[], models.Embedder], generator: Callable[[], models.Generator], prompt: str, failure: str, k: int = 5) -> DataFrame:
    """The smallest flow: nearest chunks, their texts in rank order, one prompt for each question. The answers are written once, as points are."""
    queries = questions.select("query_id", models.embed(F.col("question"), embedder, is_query=True).alias("embedding"))
    hits = search.vector_topk(queries, vectors, k)
    context = search.concat_context(hits.join(chunks.select("chunk_id", "text"), "chunk_id"))
    rows = questions.join(context, "query_id", "left")
    asked = F.concat(F.replace(F.lit(prompt), F.lit("{question}"), F.col("question")), F.lit("\n---\n"), F.coalesce("context", F.lit("")))
    return materialise(rows.select("query_id", models.generate(asked, generator, failure).alias("answer")), "answers")


def abbreviation_table(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """The short names of the settings."""
    rows = [(k, *x) for k, x in enumerate((settings or Settings()).get("abbreviations", {}).items())]
    return sources.abbreviations(spark.createDataFrame(rows, "place int, short string, full_name string"))


NAMES = {"counts": "norm_key string, type string, name string, n long", "index": "norm_key string, type string, canonical string"}


def listed_names(extractions: DataFrame) -> DataFrame:
    """filename, name, type of every entity that a paper lists, as resolve.name_counts() takes them."""
    return extractions.select("filename", F.explode("entities").alias("e")).select("filename", strip(F.col("e.name")).alias("name"), F.col("e.type").alias("type")).distinct()


def update_names(gone: DataFrame, come: DataFrame, abbreviations: DataFrame, store: SnapshotStore) -> DataFrame | None:
    """Bring counts of spellings and canonical names up to papers that went or changed (their old names) and that came (their new ones).

    gone, come: filename, name, type. Only keys whose counts change are resolved again, and only their buckets are written. Gives back
    ``renamed`` (see resolve.touched_names), written; None if no count changes.
    """
    change = store.begin()
    counts, index = (store.read(n, s) for n, s in NAMES.items())
    changes = change.append("changes", resolve.count_changes(gone, come, abbreviations))
    del change.tables["changes"]
    if changes.isEmpty():
        return None
    own, now, renamed = resolve.touched_names(counts, index, changes)
    change.replace("touched", own)
    own = change.read("touched", NAMES["counts"])
    change.replace("renamed", renamed)
    change.merge("counts", own.filter("n > 0"), ["norm_key", "type", "name"], own.filter("n <= 0"))
    emptied = change.read("renamed", renamed.schema).filter("canonical IS NULL")
    change.merge("index", now, ["norm_key", "type"], emptied)
    del change.tables["touched"]
    change.commit()
    return store.read("renamed", renamed.schema)
