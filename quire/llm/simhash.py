"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits has two segments of 32. Fingerprints within 3 bits agree in one segment up to one bit, so
every fingerprint is stored under both of its segments and looked up under each segment's Hamming ball of radius 1;
of the two fingerprints of a pair whose segments differ in one bit, the one with that bit at 0 does the look-up.
Matches are verified over all 64 bits. A bucket returns a spanning forest of its links, never all pairs. Buckets with
more than ``SPLIT`` stored fingerprints are split again by each byte of the other segment (3 differing bits leave one of
4 bytes equal), which loses no link.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; texts of fewer words than a
shingle hash as a whole; rows repeated with one doc_id each get a row; a null doc_id is never a component's name unless all
of its component are null; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.workspace import materialise, slices, unused

SHINGLE, DISTANCE, SEED = 3, 3, 42
SPLIT = 20_000
#: Shingles hashed before their bits are summed, so that a very long text needs bounded memory.
BLOCK = 1 << 16


def _bit_sums(hashes: list[int]) -> np.ndarray:
    rows = np.frombuffer(np.array(hashes, dtype="<u8").tobytes(), dtype=np.uint8).reshape(-1, 8)
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        sums = _bit_sums([digest(b" ".join(words), SEED)])
    else:
        sums = np.zeros(64, dtype=np.int64)
        for k in range(0, n, BLOCK):
            run = words[k : min(k + BLOCK, n) + width - 1]
            sums += _bit_sums([digest(b" ".join(s), SEED) for s in zip(*(run[j:] for j in range(width)))])
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: _prints(b, width), "doc_id long, fp long")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word each, or of rows of words."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def forest(stored: np.ndarray, asking: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Places (in stored and asking put together) of links that connect whatever lies within ``distance`` among stored,
    and between asking and stored.

    The walk takes each stored value once and compares it with those not yet reached, so a dense bucket costs about
    its size, and returns fewer links than it has values for each asking one's components.
    """
    one, two, label = _walk(stored, distance)
    left, right = [one], [two]
    for j, x in enumerate(asking, len(stored)):
        at = np.flatnonzero(apart(stored, x) <= distance)
        if len(at):
            _, one = np.unique(label[at], return_index=True)
            left.append(at[one])
            right.append(np.full(len(one), j))
    return np.concatenate(left), np.concatenate(right)


def _walk(stored: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of links that connect whatever lies within ``distance`` among stored, and the number of each row's tree."""
    rest, left, right, label, step = np.arange(len(stored)), [], [], np.empty(len(stored), dtype=np.int64), 0
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        label[todo[0]] = step
        while todo and len(rest):
            k = todo.pop()
            near = apart(stored[rest], stored[k]) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                label[found] = step
                todo.extend(found.tolist())
                left.append(found)
                right.append(np.full(len(found), k))
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), label


def _meet(stored: np.ndarray, trees: np.ndarray, asking: np.ndarray, asking_trees: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links between stored and asking, one for any two trees of theirs that have a pair within ``distance``.

    Every pair of rows is compared until its trees have met: first one asking row with all stored, then growing blocks.
    """
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    order = np.argsort(asking_trees, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(asking_trees[order])) + 1):
        apart_yet, k, size = np.arange(len(stored)), 0, 1
        while k < len(rows) and len(apart_yet):
            own = rows[k : k + size]
            near = np.bitwise_count(asking[own][:, None] ^ stored[apart_yet][None]).sum(axis=-1, dtype=np.int64) <= distance
            i, j = near.nonzero()
            if len(i):
                met, one = np.unique(trees[apart_yet[j]], return_index=True)
                left.append(apart_yet[j[one]])
                right.append(own[i[one]])
                apart_yet = apart_yet[~np.isin(trees[apart_yet], met)]
            k += size
            size = min(2 * size, max(1, MEET // max(1, len(apart_yet))))
    return np.concatenate(left), np.concatenate(right)


#: Buckets up to this many comparisons are verified together, larger ones by a walk each.
SMALL = 256
#: Comparisons of two trees that are made at a time.
MEET = 1 << 16


def _bucket_links(keys: np.ndarray, asks: np.ndarray, fps: np.ndarray, distance: int, most: int = SMALL, trees: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the verified links of whole buckets; rows are ordered by key, then stored before asking.

    With ``trees``, links among stored rows are known already and left out, and rows of one tree are known to be linked.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    stored = np.add.reduceat((~asks).astype(np.int64), starts)
    live = (stored > 0) & (ends - starts > 1)
    starts, ends, stored = starts[live], ends[live], stored[live]
    small = stored * (ends - starts) <= most
    left, right = [], []
    s, n, m = starts[small], (ends - starts)[small], stored[small]
    if len(s):
        pairs = n * m
        base = np.repeat(np.arange(len(s)), pairs)
        at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = at // n[base], at % n[base]
        later = j > i if trees is None else j >= m[base]
        base, i, j = base[later], i[later], j[later]
        a, b = s[base] + i, s[base] + j
        near = apart(fps[a], fps[b]) <= distance
        left.append(a[near])
        right.append(b[near])
    for lo, hi, m in zip(starts[~small].tolist(), ends[~small].tolist(), stored[~small].tolist(), strict=True):
        if trees is None:
            a, b = forest(fps[lo : lo + m], fps[lo + m : hi], distance)
        else:
            a, b = _meet(fps[lo : lo + m], trees[lo : lo + m], fps[lo + m : hi], trees[lo + m : hi], distance)
            b += m
        left.append(lo + a)
        right.append(lo + b)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of every bucket of a partition ordered by (key, ask); the last bucket of a batch waits for the next batch."""

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = _bucket_links(*rows, distance)
        ids = rows[2].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["u", "v"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy().view(np.uint64)]
        if rows[0][0] == rows[0][-1] and held and held[-1][0][-1] == rows[0][0]:
            held.append(rows)
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        held.append([c[:cut] for c in rows])
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        held = [[c[cut:] for c in rows]]
        if len(whole[0]):
            yield out(whole)
    if held:
        yield out([np.concatenate(c) for c in zip(*held, strict=True)])


def link_buckets(prints: DataFrame, distance: int = DISTANCE, split: int = SPLIT) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` that connect all pairs within ``distance`` (at most 3) bits."""
    if distance > 3:
        raise ValueError("two segments with balls of radius 1 reach 3 bits at most")
    half = F.lit(0xFFFFFFFF).cast("long")
    entry = F.explode(F.sequence(F.lit(0), F.lit(65)))
    rows = (
        prints.select("fp", entry.alias("e"))
        .select("fp", (F.col("e") / 33).cast("int").alias("seg"), (F.col("e") % 33).alias("bit"))
        .withColumn("own", F.when(F.col("seg") == 0, F.col("fp").bitwiseAND(half)).otherwise(F.shiftrightunsigned("fp", 32)))
        .withColumn("other", F.when(F.col("seg") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(half)))
        .withColumn("flip", F.when(F.col("bit") == 32, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, bit)")))
        .filter(F.col("own").bitwiseAND(F.col("flip")) == 0)
        .select(F.col("own").bitwiseOR(F.col("flip")).bitwiseOR(F.expr("shiftleft(cast(seg as bigint), 32)")).alias("key"), (F.col("bit") != 32).alias("ask"), "fp", "other")
    )
    segments = prints.select(F.explode(F.array(F.col("fp").bitwiseAND(half), F.shiftrightunsigned("fp", 32).bitwiseOR(F.lit(1 << 32)))).alias("key"))
    crowded = materialise(segments.groupBy("key").count().filter(F.col("count") > split).select("key", F.lit(True).alias("crowded")), "crowded")
    if crowded.isEmpty():
        keyed = rows.select("key", "ask", "fp")
    else:
        # The crowded keys number at most 2 / split of the fingerprints; the join stays a shuffle unless Spark sees that they are few.
        part = F.when(F.col("crowded"), F.sequence(F.lit(0), F.lit(3))).otherwise(F.array(F.lit(-1)))
        byte = F.expr("shiftright(other, 8 * part)").bitwiseAND(F.lit(255).cast("long"))
        fine = F.when(F.col("part") < 0, F.col("key")).otherwise(F.xxhash64("key", "part", byte))
        keyed = rows.join(crowded, "key", "left").withColumn("part", F.explode(part)).select(fine.alias("key"), "ask", "fp")
    ordered = keyed.repartition("key").sortWithinPartitions("key", "ask")
    return ordered.mapInArrow(lambda b: _links(b, distance), "u long, v long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links."""
    rows = materialise(fingerprints(docs, width), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    roots = components(link_buckets(prints, distance))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    known = linked.join(prints, linked["node"] == prints["fp"]).select("fp", "root", "first_id")
    names = known.groupBy("root").agg(F.min("first_id").alias("linked_id"))
    named = known.join(names, "root").select("fp", "linked_id")
    classes = prints.join(named, "fp", "left").select("fp", F.coalesce("linked_id", "first_id").alias("component_id"))
    # Written, so that both sides of the last join are bare scans, whose crowded fingerprints Spark can split.
    return rows.join(materialise(classes, "classes"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints of the pipeline: words of 64 bits, words of a shingle, and the bits up to which a pair is a candidate. Sets
#: of shingles with a Jaccard similarity of 0.8 have a cosine of 0.89 and differ in 39 +- 6 of 256 bits.
WIDE_WORDS, WIDE_SHINGLE, WIDE_DISTANCE = 4, 5, 56
#: Similarity of the sets of shingles from which two texts are near duplicates; candidates are held against it exactly.
SIMILARITY = 0.8
#: Bits of a segment, and orders of the bits that are cut into segments: 12 segments each, of which one at least differs in one
#: bit or none with probability 0.99 at that similarity.
SEGMENT, ORDERS = 20, 2
#: Rows of a bucket from which it is dealt out in pairs of blocks.
WIDE_SPLIT = 1_000_000
#: Comparisons of a bucket up to which every near pair is a link; larger ones give links that connect all near pairs.
WIDE_SMALL = 12
#: Bytes of the texts of a group that one task compares.
GROUP_BYTES = 16_000_000
_GOLDEN = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit hashes into further ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, width: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words, or none, is one shingle."""
    tokens = (text or b"").lower().split()
    n = max(1, len(tokens) - width + 1)
    digest, found = xxhash.xxh64_intdigest, []
    for k in range(0, n, BLOCK):
        run = tokens[k : min(k + BLOCK, n) + width - 1]
        shingles = zip(*(run[j:] for j in range(width))) if len(tokens) > width else [tokens]
        found.append(np.unique(np.array([digest(b" ".join(x), SEED) for x in shingles], dtype=np.uint64)))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def wide_fingerprint(hashes: np.ndarray, words: int = WIDE_WORDS) -> np.ndarray:
    """SimHash of a set of shingles, as words of 64 bits."""
    out = np.empty(words, dtype=np.uint64)
    for w in range(words):
        sums = np.zeros(64, dtype=np.int64)
        for k in range(0, len(hashes), BLOCK):
            own = _mix(hashes[k : k + BLOCK] + np.uint64((w + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
            sums += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0]
    return out


def segments(prints: np.ndarray) -> np.ndarray:
    """The segments of every fingerprint, as numbers: one row per fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    n, weights, out = bits.shape[1], (1 << np.arange(SEGMENT)).astype(np.int64), []
    for order in range(ORDERS):
        place = np.random.default_rng(order).permutation(n) if order else np.arange(n)
        for k in range(n // SEGMENT):
            out.append(bits[:, place[k * SEGMENT : (k + 1) * SEGMENT]] @ weights)
    return np.stack(out, axis=1)


_HALF = SEGMENT // 2


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under both halves of each of its segments: one of them is equal where a segment differs in one bit."""
    for batch in slices(batches, 4096):
        prints = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(1, WIDE_WORDS + 1)], axis=1)
        found = segments(prints)
        n, m = found.shape
        low, high = found & ((1 << _HALF) - 1), found >> _HALF
        place = 2 * np.arange(m)
        keys = np.concatenate([(place << _HALF) + low, ((place + 1) << _HALF) + high], axis=1).ravel()
        rest = np.concatenate([high, low], axis=1).ravel()
        row = np.repeat(np.arange(n), 2 * m)
        columns = [pa.array(keys.astype(np.int32)), pa.array(rest.astype(np.int32)), *(c.take(pa.array(row)) for c in batch.columns)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "rest", "id", "f0", "f1", "f2", "f3"])


def _wide_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of the buckets of a partition ordered by (key, block): each enumerates its balls on the other half."""

    def out(key, rest, ids, fps) -> pa.RecordBatch:
        own = (np.unique(key, return_inverse=True)[1].astype(np.int64) << _HALF) + rest
        order = np.argsort(own, kind="stable")
        own = own[order]
        pairs, trees = _within(own, fps, order, distance)
        flips = 1 << np.arange(_HALF)
        who, bit = np.nonzero((own[:, None] & flips[None, :]) == 0)
        tree = np.concatenate([trees, trees[who]])
        place = np.concatenate([order, order[who]])
        value = np.concatenate([own, own[who] | flips[bit]])
        asks = np.r_[np.zeros(len(own), dtype=bool), np.ones(len(who), dtype=bool)]
        again = np.lexsort((asks, value))
        place, value, asks, tree = place[again], value[again], asks[again], tree[again]
        a, b = _bucket_links(value, asks, _Rows(fps, place), distance, WIDE_SMALL, tree)
        u, v = np.concatenate([ids[pairs[0]], ids[place[a]]]), np.concatenate([ids[pairs[1]], ids[place[b]]])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        rows = (key, batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy(), np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(3, 3 + WIDE_WORDS)], axis=1))
        cut = int(np.searchsorted(key, key[-1]))
        held.append(tuple(c[:cut] for c in rows))
        if cut or held[0][0].size and held[0][0][0] != key[0]:
            whole = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = whole[0] == key[-1]
            if not last.all():
                yield out(*(c[~last] for c in whole))
            held = [tuple(c[last] for c in whole)]
        held.append(tuple(c[cut:] for c in rows))
    if held:
        whole = [np.concatenate(c) for c in zip(*held, strict=True)]
        if len(whole[0]):
            yield out(*whole)


def _within(own: np.ndarray, fps: np.ndarray, order: np.ndarray, distance: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Near pairs among rows of equal value (own is sorted; order gives their places), and the number of each row's tree.

    Small groups give all near pairs, and each of their rows is a tree. Larger ones give a spanning forest.
    """
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    ends = np.r_[starts[1:], len(own)]
    large = (ends - starts) ** 2 > WIDE_SMALL
    left, right, trees = [], [], np.arange(len(own))
    for lo, hi in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        a, b, label = _walk(fps[order[lo:hi]], distance)
        left.append(order[lo + b])
        right.append(order[lo + a])
        trees[lo:hi] = lo + label
    for gap in range(1, int(WIDE_SMALL**0.5)):
        at = np.flatnonzero(own[gap:] == own[:-gap])
        at = at[~np.repeat(large, ends - starts)[at]]
        near = apart(fps[order[at]], fps[order[at + gap]]) <= distance
        left.append(order[at[near]])
        right.append(order[at[near] + gap])
    none = np.empty(0, np.int64)
    return (np.concatenate([none, *left]), np.concatenate([none, *right])), trees


class _Rows:
    """Fingerprints seen through places, without a copy for every ask."""

    def __init__(self, fps: np.ndarray, place: np.ndarray) -> None:
        self.fps, self.place = fps, place

    def __getitem__(self, at) -> np.ndarray:
        return self.fps[self.place[at]]


def wide_links(prints: DataFrame, distance: int = WIDE_DISTANCE, split: int = WIDE_SPLIT) -> DataFrame:
    """Links (u, v) between the ids of distinct fingerprints (id, f0..f3) within ``distance``.

    A bucket of more than ``split`` rows is dealt out in blocks of half as many by the hash of the id, and every pair of blocks is
    a bucket, so that any two of its rows meet.
    """
    ddl = "key int, rest int, id long, f0 long, f1 long, f2 long, f3 long"
    rows = prints.select("id", "f0", "f1", "f2", "f3").mapInArrow(_dealt, ddl)
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > split)
    crowded = materialise(counts.select("key", F.ceil(2 * F.col("n") / split).cast("long").alias("blocks")), "near-crowded")
    if not crowded.isEmpty():
        # At most one row for each value of each half segment (49,152 of them), whatever the number of documents.
        rows = rows.join(F.broadcast(crowded), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        high, low = F.greatest("own", "other"), F.least("own", "other")
        pair = F.shiftright(high * (high + 1), 1) + low
        rows = rows.withColumn("key", pair * (1 << 20) + F.col("key")).select("key", "rest", "id", "f0", "f1", "f2", "f3")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _wide_links(b, distance), "u long, v long")


_SETS = ["d0", "d1"]
_WORDS = ["f0", "f1", "f2", "f3"]


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest (128 bits) and fingerprint of every text's set of shingles."""
    for batch in slices(batches):
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), dtype=np.int64).reshape(-1, 2)
        prints = np.stack([wide_fingerprint(x) for x in sets]).view(np.int64) if sets else np.empty((0, WIDE_WORDS), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for x in (digests, prints) for k in range(x.shape[1]))], names=["row", *_SETS, *_WORDS])


def similar_links(sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect all pairs of sets (sorted, distinct, not empty) with a Jaccard similarity of ``least`` or more.

    A walk as in forest(), by the exact similarity. Two such sets share one at least of their rarest members, as many as may
    miss in the other and one more; a set is compared with those that share one of its own, which loses no pair. Members that more
    than one in 64 sets have are kept as bits and counted as words, the rest by lists of their sets; both take no more memory
    than the sets.
    """
    none, n = np.empty(0, np.int64), len(sets)
    sizes = np.array([len(x) for x in sets])
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return (np.array([1]), np.array([0])) if both >= least * (sizes.sum() - both) else (none, none)
    owner = np.repeat(np.arange(n), sizes)
    _, member, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), dtype=np.int64)
    rank[order] = np.arange(len(counts))
    member, counts = rank[member], counts[order]
    shared, common = np.searchsorted(counts, [2, max(2, n // 64 + 1)])
    # The rarest members of a set that may miss, and one more: whether a common one is among them.
    rare = sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1
    wide = np.bincount(owner[member < common], minlength=n) < rare
    bits = _member_bits(owner, member - common, n, len(counts) - common)
    listed = (member >= shared) & (member < common)
    who, posted = owner[listed], member[listed]
    begins = np.searchsorted(who, np.arange(n + 1))
    by = np.argsort(posted, kind="stable")
    lists, at = who[by], np.searchsorted(posted[by], np.arange(shared, common + 1))
    rest, live, alive = np.ones(n, dtype=bool), n, np.arange(n)
    left, right = [none], [none]
    for begin in range(n):
        if not rest[begin]:
            continue
        rest[begin], todo, live = False, [begin], live - 1
        while todo and live:
            k = todo.pop()
            own = posted[begins[k] : begins[k + 1]] - shared
            met = np.concatenate([none, *(lists[at[m] : at[m + 1]] for m in own.tolist())])
            if wide[k]:
                if 2 * live < len(alive):
                    alive = np.flatnonzero(rest)
                near, both = alive, np.bincount(met, minlength=n)[alive]
            else:
                near, both = np.unique(met, return_counts=True)
            fit = rest[near] & (sizes[near] >= least * sizes[k]) & (least * sizes[near] <= sizes[k])
            near, both = near[fit], both[fit]
            if not len(near):
                continue
            both = both + np.bitwise_count(bits[near] & bits[k]).sum(axis=1, dtype=np.int64)
            found = near[both >= least * (sizes[k] + sizes[near] - both)]
            rest[found], live = False, live - len(found)
            todo.extend(found.tolist())
            left.append(found)
            right.append(np.full(len(found), k))
    return np.concatenate(left), np.concatenate(right)


def _member_bits(owner: np.ndarray, member: np.ndarray, n: int, width: int) -> np.ndarray:
    """Rows of words with a bit for each member from 0 up; owner is sorted."""
    words = -(-width // 64)
    out = np.zeros((n, words), dtype=np.uint64)
    owner, member = owner[member >= 0], member[member >= 0]
    step = max(1, BLOCK * 64 // max(1, words * 64))
    for lo in range(0, n, step):
        a, b = np.searchsorted(owner, [lo, lo + step])
        rows = np.zeros((min(step, n - lo), words * 64), dtype=bool)
        rows[owner[a:b] - lo, member[a:b]] = True
        out[lo : lo + step] = np.packbits(rows, axis=1, bitorder="little").view(np.uint64)
    return out


def _similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the groups of a partition of (group, block, row, text) ordered by (group, block)."""
    held, rows, sets = None, [], []

    def out() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            ids = np.array(rows, dtype=np.int64)
            a, b = similar_links(sets, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["u", "v"])

    for batch in slices(batches):
        for group, block, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, block) != held:
                yield from out()
                held, rows, sets = (group, block), [], []
            rows.append(row)
            sets.append(shingle_set(text))
    yield from out()


def exact_links(groups: DataFrame, texts: DataFrame, least: float = SIMILARITY, most: int = GROUP_BYTES) -> DataFrame:
    """Links (u, v) that connect all pairs of similar texts (row, text) within each group (node, root).

    Each member's text moves once. A group of more than ``most`` bytes is dealt out in blocks, and every pair of blocks is a task.
    """
    rows = materialise(texts.join(groups.select(F.col("node").alias("row"), F.col("root").alias("group")), "row"), "near-texts")
    large = rows.groupBy("group").agg(F.sum(F.octet_length("text")).alias("bytes")).filter(F.col("bytes") > most)
    # At most one row for each ``most`` bytes of text.
    large = large.select("group", F.ceil(2 * F.col("bytes") / most).cast("int").alias("blocks"))
    rows = rows.join(F.broadcast(large), "group", "left")
    own, other = F.pmod(F.xxhash64("row"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    rows = rows.select("group", "row", "text", own.alias("own"), other.alias("other"))
    # Of two blocks, the greater one's number and the smaller one's make the number of the pair.
    high, low = F.greatest("own", "other"), F.least("own", "other")
    rows = rows.select("group", F.coalesce(F.when(F.col("own").isNotNull(), high * (high + 1) / 2 + low), F.lit(0)).cast("long").alias("block"), "row", "text")
    return rows.repartition("group", "block").sortWithinPartitions("group", "block").mapInArrow(lambda b: _similar(b, least), "u long, v long")


def loose_groups(sets: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """Groups (node, root) of the ids of sets (id, f0..f3) whose fingerprints are equal or linked by wide_links()."""
    prints = materialise(sets.groupBy(*_WORDS).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "near-prints")
    # Unequal sets with equal fingerprints are hardly ever more than a few; written, so that Spark sees how many.
    twins = materialise(prints.filter("n > 1").select(*_WORDS, F.col("id").alias("v")), "near-twins")
    same = sets.join(twins, _WORDS).filter("id <> v").select(F.col("id").alias("u"), "v")
    # Written before the links are contracted, so that a task has one Python process at a time.
    loose = components(materialise(wide_links(prints, distance).unionByName(same), "near-pairs"))
    return loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())


def representatives(docs: DataFrame, distance: int = WIDE_DISTANCE) -> DataFrame:
    """The rows of docs, with all their columns, without all but one of each class of near duplicates.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; a class is what such pairs connect.
    Equal sets are one row of the search. Fingerprints of 256 bits give groups of candidates, within which the sets of all pairs
    decide, also of those with equal fingerprints.

    Defined cases: null, empty and blank texts are one class; a text of fewer than five words is one shingle, so that it is near its
    equals alone; of rows repeated with one doc_id one stays; which row of a class stays is not defined; null ids and other columns,
    whatever their names, are kept as they are; an empty table gives an empty result.
    """
    row = unused(docs.columns, "near row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    texts = rows.select(F.col(f"`{row}`").alias("row"), F.col("text").cast("binary").alias("text"))
    found = texts.mapInArrow(_wide, "row long, " + ", ".join(f"{c} long" for c in _SETS + _WORDS))
    sets = materialise(found.groupBy(*_SETS).agg(F.min("row").alias("id"), *[F.min(c).alias(c) for c in _WORDS]).drop(*_SETS), "near-sets")
    roots = components(materialise(exact_links(loose_groups(sets, distance), texts), "near-links"))
    kept = sets.select(F.col("id").alias(row)).join(roots.select(F.col("node").alias(row)), row, "left_anti")
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
