"""Source divergence audit: how far the sources of a language lie apart in their kept terms, and which terms mark a source.

Terms become integers. A batch codes its terms and counts them by ``bincount`` for each (lang, source); the counts of a term
meet in one place, which decides whether the language keeps it. The kept terms of all languages are then sorted and cut into
slices; a slice's sorted array gives ids by ``searchsorted``, so that ids follow the UTF-8 order of the terms and ties need no
text. Runs of WIDTH ids are chunks; a chunk and a block of BLOCK sources are one dense vector of shares, and two blocks of a chunk
give the partial distances of their sources. No dictionary is sent to the tasks, and no task holds more than two such blocks.

All arithmetic is in whole numbers: a share in billionths is found by a long division in steps of a thousand.

Defined cases: null text, lang and source are ''; a group without terms has its pairs, at distances by zero counts; a language
that keeps no term has pairs of value 0 and no terms; repeated rows count as documents of their own; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.terms import byte_class, coded_words, slices_of_bytes, summed
from quire.llm.workspace import ROW_BITS, materialise

MIN_DOCUMENTS = 30
#: Added to every count, and the unit of shares.
EXTRA, UNIT = 5, 10**9
MOST_TERMS = 50
#: Kept terms of a chunk and sources of a block: a dense vector of both is 256 KB.
WIDTH, BLOCK = 1024, 32

LETTERS = byte_class()
_COUNTS = "lang string, source string, term string, n long, df long"
_IDS = "lang string, source string, term string, n long, lang_n long, opens int, id long"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group; each group also gives a row without a term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def tables() -> Iterator[pa.Table]:
        for batch in slices_of_bytes(batches, 2):
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            row_group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            codes, names, sizes = coded_words(batch.column(2), LETTERS)
            row_of = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(row_group, kind="stable")
            ends = np.cumsum(sizes)
            found = []
            for rows in np.split(order, np.flatnonzero(np.diff(row_group[order])) + 1):
                inside = np.concatenate([np.arange(ends[r] - sizes[r], ends[r]) for r in rows])
                own = codes[inside]
                n = np.bincount(own, minlength=len(names))
                df = np.bincount(np.unique(row_of[inside] * max(1, len(names)) + own) % max(1, len(names)), minlength=len(names))
                met = np.flatnonzero(n)
                found.append((row_group[rows[0]], met, n[met], df[met]))
            group = np.concatenate([np.full(len(m) + 1, g) for g, m, _, _ in found])
            term = np.concatenate([np.append(m, len(names)) for _, m, _, _ in found])
            words = pa.concat_arrays([names, pa.array([b""], names.type)])
            yield pa.table(
                [
                    langs.dictionary.take(pa.array(group // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(group % len(sources.dictionary))),
                    words.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()),
                    pa.array(np.concatenate([np.append(n, 0) for _, _, n, _ in found])),
                    pa.array(np.concatenate([np.append(d, 0) for _, _, _, d in found])),
                ],
                schema=schema,
            )

    yield from summed(tables(), ["lang", "source", "term"], ["n", "df"])


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of ordered rows (lang, source, term, ...): places in this slice's sorted terms, after those of earlier batches."""
    base, last = TaskContext.get().partitionId() << ROW_BITS, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.empty(batch.num_rows, dtype=object)
        keys[:] = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        terms = sorted(set(keys))
        known = np.empty(len(terms), dtype=object)
        known[:] = terms
        base -= last == terms[0]
        ids = base + np.searchsorted(known, keys)
        base, last = base + len(terms), terms[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, "id"])


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count, total, kept, whole=_whole):
    """1 + floor(UNIT * (count + 5) / (total + 5 * kept)), of columns or arrays, without a product beyond 64 bits."""
    rest, of = count + EXTRA, total + EXTRA * kept
    out = whole(rest, of)
    for _ in range(3):
        rest = (rest % of) * 1000
        out = out * 1000 + whole(rest, of)
    return out + 1


def _dense(sparse: pa.Table, cell: pa.Table) -> pa.Table:
    """The shares of a block's sources over the terms of a chunk. cell: one row with the block's totals and the chunk's ids."""
    lang, chunk, block, low, width, totals, kept = (cell[c][0].as_py() for c in ("lang", "chunk", "block", "low", "width", "totals", "kept"))
    counts = np.zeros((len(totals), width), dtype=np.int64)
    if sparse.num_rows:
        counts[sparse["place"].to_numpy() % BLOCK, sparse["id"].to_numpy() - low] = sparse["n"].to_numpy()
    shares = share(counts, np.array(totals, dtype=np.int64)[:, None], kept, np.floor_divide)
    return pa.table({"lang": [lang], "chunk": [chunk], "block": pa.array([block], pa.int32()), "members": pa.array([len(totals)], pa.int32()), "shares": pa.array([shares.tobytes()], pa.binary())})


_CELL = "lang string, chunk long, block int, members int, shares binary"


def _distances(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial distances of the sources of two blocks of one chunk."""
    for batch in batches:
        for k in range(batch.num_rows):
            lang, one, n_one, left, two, n_two, right = (c[k].as_py() for c in batch.columns)
            a, b = np.frombuffer(left, np.int64).reshape(n_one, -1), np.frombuffer(right, np.int64).reshape(n_two, -1)
            for i in range(n_one):
                j = np.arange(i + 1 if one == two else 0, n_two)
                if len(j):
                    apart = np.abs(b[j] - a[i]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(j), pa.string()), pa.array(np.full(len(j), one * BLOCK + i, np.int32)), pa.array((two * BLOCK + j).astype(np.int32)), pa.array(apart)], names=["lang", "a", "b", "part"])


def kept_counts(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n, opens: counts of the kept terms, a language's own count, and 1 in one row of each term.

    A row with term '' and no counts stands for each group.
    """
    whole = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*whole).mapInArrow(_count, _COUNTS).repartition("lang", "term")
    of_term = Window.partitionBy("lang", "term")
    sums = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    sums = sums.withColumn("lang_df", F.sum("df").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term)).withColumn("opens", (F.row_number().over(of_term.orderBy("source")) == 1).cast("int"))
    return sums.filter((F.col("term") == "") | (F.col("lang_df") >= least)).select("lang", "source", "term", "n", "lang_n", "opens")


def _groups(kept: DataFrame) -> DataFrame:
    """lang, source, place, total, lang_total, kept: each group's place in the order of its language's sources, and its totals."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term") != "", F.col("opens")).otherwise(0)).alias("opened"))
    of_lang = Window.partitionBy("lang")
    return own.select(
        "lang", "source", "total", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"), F.sum("total").over(of_lang).alias("lang_total"), F.sum("opened").over(of_lang).alias("kept")
    )


def _pairs(coded: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of every two sources of a language, in both orders."""
    block = F.floor(F.col("place") / BLOCK).cast("int").alias("block")
    rows = F.array_sort(F.collect_list(F.struct("place", "total")))
    blocks = groups.groupBy("lang", block, "kept").agg(F.transform(rows, lambda x: x["total"]).alias("totals"))
    ids = coded.withColumn("chunk", F.floor(F.col("id") / WIDTH))
    chunks = ids.groupBy("lang", "chunk").agg(F.min("id").alias("low"), (F.max("id") - F.min("id") + 1).alias("width"))
    cells = chunks.join(blocks, "lang").select(*(F.col(c).alias(c) for c in ("lang", "chunk", "block", "low", "width", "totals", "kept")))
    sparse = ids.join(groups.select("lang", "source", "place"), ["lang", "source"]).select("lang", "chunk", block, "place", "id", "n")
    dense = sparse.groupBy("lang", "chunk", "block").cogroup(cells.groupBy("lang", "chunk", "block")).applyInArrow(_dense, _CELL)
    dense = materialise(dense, "divergence-dense")
    other = dense.select("lang", "chunk", F.col("block").alias("other"), F.col("members").alias("others"), F.col("shares").alias("beside"))
    met = dense.join(other, ["lang", "chunk"]).filter("block <= other").select("lang", "block", "members", "shares", "other", "others", "beside")
    sums = met.mapInArrow(_distances, "lang string, a int, b int, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))

    one = groups.select("lang", "source", F.col("place").alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("q"))
    both = one.join(two, "lang").filter("p <> q").withColumn("a", F.least("p", "q")).withColumn("b", F.greatest("p", "q"))
    return both.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: distances of sources (``pair``) and the terms that mark a source (``term``, to rank ``most``)."""
    kept = materialise(kept_counts(docs, least), "divergence-kept")
    groups = materialise(_groups(kept), "divergence-groups")
    order = ["lang", "term", "source"]
    coded = kept.filter("term <> ''").repartitionByRange("lang", "term").sortWithinPartitions(*order).mapInArrow(_encode, _IDS)
    coded = materialise(coded, "divergence-ids")

    of_group = Window.partitionBy("lang", "source")
    pairs = _pairs(coded, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item")))
    valued = coded.join(groups, ["lang", "source"]).withColumn("value", share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    terms = valued.filter("value > 0").withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "id"))).filter(F.col("rank") <= most)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(terms.withColumn("part", F.lit("term")).withColumnRenamed("term", "item").select(*columns))
