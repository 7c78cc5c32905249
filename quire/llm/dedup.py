"""Grace hash deduplication of whole texts.

Records are split by digest bits into spill files, in the folders that Spark gives a task, until each bucket fits an
open-addressing table that compares complete content. The table runs twice: inside every input partition, so that a group of
copies of any size leaves one record for each MEMBERS rows of a partition, and then over those records after one shuffle on the
digest.

Defined cases: null text counts as empty; empty texts form one group; a null doc_id ranks after every other; rows
repeated with the same doc_id are separate members of which one is kept; an empty table gives an empty result;
input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quire.llm.workspace import materialise, numbered, slices

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of distinct content that one table may hold before its bucket is split, files per split, slots at the start.
TABLE_BYTES, FANOUT, SLOTS = 96 << 20, 16, 1 << 10
NO_ID = 1 << 63
#: Rows of a partition that go through one table at a time, as a table keeps the ids of all members.
MEMBERS = 1 << 19
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


class OpenTable:
    """Linear probing over digests; two records are one group only if their complete contents are equal."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * SLOTS
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.held = 0

    def place(self, digest: bytes, content: bytes) -> tuple[int, bool]:
        """Index of the content's group, and whether it is new."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (k := self.slots[at]) >= 0:
            if self.digests[k] == digest and self.contents[k] == content:
                return k, False
            at = (at + 1) & mask
        k = len(self.contents)
        self.slots[at] = k
        self.digests.append(digest)
        self.contents.append(content)
        self.held += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, digest in enumerate(self.digests):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def spill_folder() -> str | None:
    """One of the folders that Spark gives the task for its own spills; the system's where it names none."""
    folders = [x for x in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if x]
    context = TaskContext.get()
    return folders[(context.partitionId() if context else 0) % len(folders)] if folders else None


def _branch(digest: bytes, level: int) -> int:
    byte = digest[level // 2]
    return byte >> 4 if level % 2 == 0 else byte & 15


def grace_groups(records: Iterable[tuple], limit: int = TABLE_BYTES, level: int = 0, folder: str | None = None, best: Callable | None = None) -> Iterator[tuple[bytes, bytes, list]]:
    """Groups (digest, content, members) of records (digest, content, member); memory is bounded by ``limit`` plus the members.

    With ``best``, a key function, a group holds only its smallest member.

    Past the last digest bit records with equal digests stay in one table, which still compares contents.
    """
    table, members = OpenTable(), []
    records = iter(records)
    deepest = level >= 2 * 16
    for digest, content, member in records:
        k, new = table.place(digest, content)
        if new:
            members.append([member])
        elif best is None:
            members[k].append(member)
        elif best(member) < best(members[k][0]):
            members[k][0] = member
        if table.held > limit and not deepest and len(table.contents) > 1:
            break
    else:
        yield from zip(table.digests, table.contents, members, strict=True)
        return

    def all_records() -> Iterator[tuple]:
        for digest, content, own in zip(table.digests, table.contents, members, strict=True):
            for member in own:
                yield digest, content, member
        yield from records

    with tempfile.TemporaryDirectory(prefix="grace-", dir=folder or spill_folder()) as spill:
        paths = [os.path.join(spill, str(k)) for k in range(FANOUT)]
        files = [open(p, "wb") for p in paths]
        try:
            for record in all_records():
                pickle.dump(record, files[_branch(record[0], level)], protocol=5)
        finally:
            for f in files:
                f.close()
        table, members = OpenTable(), []
        for path in paths:
            yield from grace_groups(_spilled(path), limit, level + 1, spill, best)
            os.unlink(path)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += sum(len(x) for x in row if isinstance(x, bytes))
        if len(block) >= BATCH_ROWS or held > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)
            block, held = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block, strict=True), schema, strict=True)], schema=schema)


LOCAL = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("head", pa.int64()), ("sha", pa.string()), ("n_chars", pa.int64()), ("copies", pa.int64()), ("digest", pa.binary()), ("content", pa.binary())])
LOCAL_DDL = "rid long, doc_id long, head long, sha string, n_chars long, copies long, digest binary, content binary"
GLOBAL = pa.schema([("head", pa.int64()), ("keep_rid", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
GLOBAL_DDL = "head long, keep_rid long, keep_id long, group_size long"


def _rank(n_chars: int, doc_id: int | None, rid: int) -> tuple:
    return (-n_chars, NO_ID if doc_id is None else doc_id, rid)


def _local(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Members of every local group; only the group's head carries its content. A group may have a head for each MEMBERS rows."""
    first = TaskContext.get().partitionId() << 36

    def records() -> Iterator[tuple]:
        rid = first
        for batch in slices(batches):
            for doc_id, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                content = (text or b"").translate(None, BLANKS)
                yield hashlib.blake2b(content, digest_size=16).digest(), content, (n or 0, doc_id, rid)
                rid += 1

    def groups() -> Iterator[tuple]:
        source = records()
        for record in source:
            yield from grace_groups(itertools.chain([record], itertools.islice(source, MEMBERS - 1)), limit)

    def rows() -> Iterator[tuple]:
        for digest, content, members in groups():
            sha = hashlib.sha256(content).hexdigest()
            head = min(members, key=lambda m: _rank(*m))
            for m in members:
                own = m is head
                yield m[2], m[1], head[2], sha, m[0], len(members) if own else None, digest if own else None, content if own else None

    yield from _batches(rows(), LOCAL)


def _global(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for batch in slices(batches):
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for digest, content, n, doc_id, rid, copies in zip(*cols, strict=True):
                yield digest, content, (n, doc_id, rid, copies)

    def rows() -> Iterator[tuple]:
        for _, _, members in grace_groups(records(), limit):
            best = min(members, key=lambda m: _rank(*m[:3]))
            size = sum(m[3] for m in members)
            for m in members:
                yield m[2], best[2], best[1], size

    yield from _batches(rows(), GLOBAL)


def grace_dedup(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.length("text").cast("long").alias("n"))
    local = materialise(text.mapInArrow(lambda b: _local(b, limit), LOCAL_DDL), "grace")
    heads = local.filter(F.col("copies").isNotNull()).select("digest", "content", "n_chars", "doc_id", "rid", "copies")
    groups = heads.repartition("digest").mapInArrow(lambda b: _global(b, limit), GLOBAL_DDL)
    members = local.select("rid", "doc_id", "head", "sha")
    return members.join(groups, "head").select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _best_rows(batches: Iterator[pa.RecordBatch], doc_at: int, text_at: int, limit: int, dealt: bool) -> Iterator[pa.RecordBatch]:
    """The row to keep of each group; rows that have been dealt out by digest carry digest and rid as their last columns."""
    first, schema = TaskContext.get().partitionId() << 36, None

    def records() -> Iterator[tuple]:
        nonlocal schema
        rid = first
        for batch in slices(batches):
            schema = schema or batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = row[text_at] or ""
                content = text.encode("utf-8", "surrogatepass").translate(None, BLANKS)
                digest = row[-2] if dealt else hashlib.blake2b(content, digest_size=16).digest()
                yield digest, content, (_rank(len(text), row[doc_at], row[-1] if dealt else rid), row)
                rid += 1

    block, held = [], 0

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*block, strict=True))
        if dealt:
            fields = list(schema)[:-2]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns[:-2], fields, strict=True)], schema=pa.schema(fields))
        fields = [*schema, pa.field("digest", pa.binary()), pa.field("rid", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    for digest, _, members in grace_groups(records(), limit, best=lambda m: m[0]):
        rank, row = members[0]
        block.append(row if dealt else (*row, digest, rank[2]))
        held += len(row[text_at] or "")
        if len(block) >= BATCH_ROWS or held > BATCH_BYTES:
            yield flushed()
            block, held = [], 0
    if block:
        yield flushed()


def distinct_rows(docs: DataFrame, limit: int = TABLE_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that grace_dedup keeps; their order is lost.

    Nulls, empty texts, ties, repeats and empty tables as in grace_dedup; other columns, whatever their names, are kept as they are.
    """
    at = docs.columns.index("doc_id"), docs.columns.index("text")
    rows = numbered(docs)
    wide = StructType([*rows.schema.fields, StructField("digest", BinaryType()), StructField("rid", LongType())])
    heads = rows.mapInArrow(lambda b: _best_rows(b, *at, limit, False), wide).repartition("digest")
    return heads.mapInArrow(lambda b: _best_rows(b, *at, limit, True), rows.schema).toDF(*docs.columns)
