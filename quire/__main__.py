"""Command line: index, extract, import, graph, retrieve, answer, ask and dump over one store.

``--embedder``, ``--extractor``, ``--reranker`` and ``--generator`` take ``package.module:factory``, a callable without arguments
that the workers can import. Without them the settings decide (``embedding.model`` and ``rerank.model`` name folders of local
transformers, ``chat.base_url`` a service for the other two), and without those the offline models answer.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from pathlib import Path
from queue import Queue
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import models, prompts
from quire.functions.remote import chat_of
from quire.functions.text import snippet
from quire.functions.transformer import embedder_of, reranker_of
from quire.operators import graph as graphs
from quire.operators.select import merge_dedup, source_counts
from quire.plans import flows
from quire.settings import DEFAULTS, Settings, merged
from quire.sources import files as sources
from quire.sources.snapshots import SnapshotStore

DEFAULT_MODELS: dict[str, Callable[[], Any]] = {
    "embedder": models.HashEmbedder,
    "extractor": models.RuleExtractor,
    "reranker": models.LexicalReranker,
    "generator": partial(models.ExtractiveGenerator, prompts.IRRELEVANT),
}


def factory(kind: str, name: str | None, settings: Settings | None = None, stage: str = "") -> Callable[[], Any]:
    """The model of a kind: the one named, else that of the settings for the stage, else the offline one."""
    if name is not None:
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)
    made = None
    if settings is not None:
        made = embedder_of(settings) if kind == "embedder" else reranker_of(settings) if kind == "reranker" else chat_of(settings, stage)
    return made or DEFAULT_MODELS[kind]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire", description="A literature library on Spark.")
    top.add_argument("--store", required=True, help="folder of the tables, on storage that all executors reach")
    top.add_argument("--settings", help="JSON file of settings")
    for kind in DEFAULT_MODELS:
        top.add_argument(f"--{kind}", help="package.module:factory")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index", help="split and embed new and changed files")
    extract = commands.add_parser("extract", help="extract entities, relations and results from new and changed files")
    for one in (index, extract):
        one.add_argument("--data", required=True, help="folder of Markdown files")
    # An index follows its whole folder: files that a limit left out would count as removed.
    extract.add_argument("--limit", type=int, help="first files by name")
    graph = commands.add_parser("graph", help="build the graph over the old one")
    graph.add_argument("--abbreviations", help="JSON object of short and full names")
    graph.add_argument("--reset", action="store_true", help="in place of the old one")
    graph.add_argument("--prune", action="store_true", help="take out what the build no longer makes")
    load = commands.add_parser("import", help="take in extractions kept as one JSON object by file name")
    load.add_argument("--cache", required=True, help="the JSON file")
    for name in ("retrieve", "answer", "ask"):
        one = commands.add_parser(name)
        one.add_argument("question")
        one.add_argument("-k", type=int)
        one.add_argument("--hops", type=int)
        one.add_argument("--top-n", type=int)
        one.add_argument("--points", action="store_true", help="show the compressed points as well")
    dump = commands.add_parser("dump", help="list the chunks of the index")
    dump.add_argument("--to", help="write them to this folder as JSON lines instead")
    return top


class Library:
    def __init__(self, spark: SparkSession, options: argparse.Namespace) -> None:
        self.spark, self.options = spark, options
        root = options.store.rstrip("/")
        self.index, self.extractions, self.graph = (SnapshotStore(spark, f"{root}/{n}") for n in ("index", "extractions", "graph"))
        given = json.loads(Path(options.settings).read_text(encoding="utf-8")) if options.settings else {}
        chosen = {n: getattr(options, n, None) for n in ("k", "hops")}
        self.settings = Settings(merged(merged(DEFAULTS, given), {"retrieval": {n: x for n, x in chosen.items() if x is not None}}))

    def done(self, store: SnapshotStore, version: int | None) -> str:
        """What a command says of its commit; versions beyond ``store.versions`` go."""
        if version is None:
            return "nothing changed"
        store.expire(self.settings.get("store.versions", 2))
        return f"version {version}"

    def model(self, kind: str, stage: str = "") -> Callable[[], Any]:
        return factory(kind, getattr(self.options, kind), self.settings, stage)

    def chunks(self) -> DataFrame:
        return self.index.read("chunks", flows.CHUNKS)

    def questions(self) -> DataFrame:
        return self.spark.createDataFrame([("q", self.options.question)], "query_id string, question string")

    def found(self) -> tuple[DataFrame, DataFrame]:
        """Chunks by vector and by graph, before they are merged."""
        queries = self.questions().select("query_id", models.embed(F.col("question"), self.model("embedder"), is_query=True).alias("embedding"))
        edges = self.graph.read("edges", flows.GRAPH_SCHEMAS["edges"])
        entities = self.graph.read("entities", flows.GRAPH_SCHEMAS["entities"]).select(graphs.entity_key(F.col("name"), F.col("type")).alias("entity"), "name", "type")
        plain = edges.select(F.col("src_key").alias("src"), "rel_type", F.col("dst_key").alias("dst"))
        return flows.retrieve_parts(queries, self.index.read("vectors", flows.VECTORS), plain, entities, flows.mentions_of(edges), self.settings)

    def points(self) -> DataFrame:
        top_n = self.options.top_n or self.settings.get("rerank.top_n", 10)
        compressor = self.model("generator", "compression")
        return flows.answer_points(self.questions(), merge_dedup(*self.found()), self.chunks(), self.model("reranker"), compressor, prompts.COMPRESSION, prompts.IRRELEVANT, prompts.FAILED, top_n, self.settings)


def run(spark: SparkSession, arguments: list[str]) -> Iterator[str]:
    """The lines that the command prints, as they come."""
    options = parser().parse_args(arguments)
    yield from COMMANDS[options.command](Library(spark, options))


def as_told(work: Callable[[Callable[[str], None]], str]) -> Iterator[str]:
    """The lines that work tells while it runs, as it tells them, and then its result."""
    lines: Queue[str | None] = Queue()
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(work, lines.put)
        running.add_done_callback(lambda _: lines.put(None))
        yield from iter(lines.get, None)
        yield running.result()


def _index(library: Library) -> Iterator[str]:
    version = flows.update_index_folder(library.spark, library.options.data, library.index, library.model("embedder"), library.settings)
    yield library.done(library.index, version)


def _extract(library: Library) -> Iterator[str]:
    files = sources.scan_markdown(library.spark, library.options.data, library.options.limit)
    extractor = library.model("extractor", "extraction")

    def work(tell: Callable[[str], None]) -> str:
        version = flows.update_extractions(files, library.extractions, extractor, library.settings, lambda done, of: tell(f"{done} of {of} papers"))
        return library.done(library.extractions, version)

    yield from as_told(work)


def _import(library: Library) -> Iterator[str]:
    papers = sources.read_extraction_json(library.spark, library.options.cache)
    version = flows.import_extractions(papers, library.extractions)
    yield library.done(library.extractions, version)


def _graph(library: Library) -> Iterator[str]:
    spark, options = library.spark, library.options
    papers = library.extractions.read("extractions", flows.EXTRACTIONS)
    if papers.isEmpty():
        yield "no extractions: run extract first"
        return
    short = sources.read_abbreviations(spark, options.abbreviations) if options.abbreviations else flows.abbreviation_table(spark, library.settings)
    chunks = library.chunks()
    totals: dict[str, int] = {}
    version = flows.update_graph(papers, chunks, short, library.graph, options.reset, options.prune, totals, lambda name, n: print(f"built {name}: {n}", file=sys.stderr, flush=True))
    yield library.done(library.graph, version)
    taken = {"papers": totals["papers"], "entities": totals["entities_rows"], "chunks": totals["chunks_rows"]} | {n: totals[n] for n in ("mentions", "relations", "results")}
    yield "taken in: " + ", ".join(f"{n} {name}" for name, n in taken.items())
    whole = graphs.Graph(**{n: library.graph.read(n, s) for n, s in flows.GRAPH_SCHEMAS.items()})
    for r in (*graphs.node_counts(graphs.node_keys(whole)).collect(), *graphs.edge_counts(whole.edges).collect()):
        yield f"{r[0]}: {r[1]}"


def _dump(library: Library) -> Iterator[str]:
    rows = sources.index_dump(library.chunks().withColumn("source", F.col("filename"))).orderBy("chunk_id")
    if library.options.to:
        rows.write.json(library.options.to)
        yield f"written to {library.options.to}"
        return
    for r in rows.toLocalIterator():
        yield f"{r.chunk_id} ({r.source}, {r.n_chars} characters)\n{r.text}"


def _retrieve(library: Library) -> Iterator[str]:
    vector, graph = library.found()
    counts = source_counts(vector, graph).first()
    rows = merge_dedup(vector, graph).join(library.chunks().select("chunk_id", snippet(F.col("text")).alias("snippet")), "chunk_id").orderBy("merged_pos").collect()
    yield f"{counts.vector_count if counts else 0} by vector, {counts.graph_count if counts else 0} by graph, {len(rows)} merged"
    for r in rows:
        yield f"{r.chunk_id} [{r.source}] {r.snippet}"


def _ask(library: Library) -> Iterator[str]:
    k = library.options.k or library.settings.get("retrieval.k", 5)
    made = flows.flat_answers(library.questions(), library.index.read("vectors", flows.VECTORS), library.chunks(), library.model("embedder"), library.model("generator", "demo"), prompts.DEMO, prompts.FAILED, k)
    for r in made.collect():
        yield r.answer


def _answer(library: Library) -> Iterator[str]:
    points = library.points().orderBy("number").collect()  # at most top_n rows
    kept = library.spark.createDataFrame(points, "query_id string, number int, chunk_id string, filename string, text string")
    yield flows.answers(library.questions(), kept, library.model("generator", "generation"), prompts.ANSWER, prompts.NO_SOURCE, prompts.FAILED).first().answer
    for p in points:
        yield f"[{p.number}] {p.filename}" + (f": {p.text}" if library.options.points else "")


COMMANDS: dict[str, Callable[[Library], Iterator[str]]] = {"import": _import, "index": _index, "extract": _extract, "graph": _graph, "retrieve": _retrieve, "answer": _answer, "ask": _ask, "dump": _dump}


def main() -> None:
    spark = SparkSession.builder.appName("quire").getOrCreate()
    try:
        for line in run(spark, sys.argv[1:]):
            print(line, flush=True)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
