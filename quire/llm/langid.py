"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of up to three symbols with frozen counts. A symbol that a context has seen
costs its share of the context; any other costs the context's escape and then its price in the next shorter context. The
language whose tree gives a whole text the shortest code is predicted.

The trees of all languages are flattened into one table with a row for every context that any language has seen, so that
scoring a text is two array look-ups per byte. Symbols are bytes after lower-casing A-Z, with white space, digits and
other ASCII marks as one symbol each and bytes above 127 that training has not seen as one symbol. Which of a symbol's bytes stands
in the text costs the logarithm of their number in every language, so that the lengths are those of a code of the bytes.

Trees are fitted on a bounded sample: about ``SAMPLE_ROWS`` whole texts of each language (all, where it has fewer), by the
hash of their id; more than ``MOST_LANGUAGES`` languages are refused. The table that is sent out has at most ``MODEL_BYTES``: where
many languages and scripts would need more, contexts are shorter by as many symbols as it takes.

Defined cases: null text and texts without a letter are ``und`` with score 0, as is every text if nothing could be
learned; rows with a null id or lang are never learned from and not held out; repeated rows are predicted one by one; an
empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.workspace import numbered, slices

DEPTH, SAMPLE_ROWS, BLOCK = 3, 300, 1 << 19
MOST_LANGUAGES, MODEL_BYTES = 500, 256 << 20
UNKNOWN = "und"
#: Bits per byte above which a text fits no learned language, for `accepted`: those of plain bytes.
MOST_BITS = 8.0
#: Bytes whose evidence counts as one observation in the score, so that long texts don't all end at 1.
EVIDENCE = 64
SPACE, DIGIT, MARK, OTHER = 0, 1, 2, 3


def byte_symbols() -> np.ndarray:
    """Symbols before training: letters and high bytes are themselves, above the four shared ones."""
    table = np.arange(256, dtype=np.int64)
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalpha() else DIGIT if c.isdigit() else SPACE if c.isspace() else MARK
    return table


RAW = byte_symbols()


def _grams(symbols: np.ndarray, base: int) -> np.ndarray:
    """Codes of every symbol with its DEPTH predecessors; a text begins after blanks."""
    padded = np.concatenate([np.zeros(DEPTH, dtype=np.int64), symbols])
    code = padded[: len(symbols)]
    for k in range(1, DEPTH + 1):
        code = code * base + padded[k : len(symbols) + k]
    return code


@dataclass
class Model:
    languages: list[str]
    #: Symbol of each byte, bits that tell it from the others of its symbol, number of symbols, symbols of a context.
    symbols: np.ndarray
    apart: np.ndarray
    width: int
    depth: int
    #: Row of each context, and bits[row * width + symbol, language].
    rows: np.ndarray
    bits: np.ndarray

    def lengths(self, text: bytes) -> np.ndarray:
        """Code length in bits under each language."""
        total, data = np.zeros(len(self.languages)), np.frombuffer(text, dtype=np.uint8)
        before = np.zeros(self.depth, dtype=np.int64)
        for k in range(0, len(data), BLOCK):
            part = np.concatenate([before, self.symbols[data[k : k + BLOCK]]])
            n = len(part) - self.depth
            context = part[:n] if self.depth else np.zeros(n, dtype=np.int64)
            for d in range(1, self.depth):
                context = context * self.width + part[d : n + d]
            total += self.bits[self.rows[context] * self.width + part[self.depth :]].sum(axis=0, dtype=np.float64)
            before = part[n:]
        return total + np.bincount(data, minlength=256) @ self.apart


def _symbols(grams: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the symbols that training has seen, by their byte, and how many there are."""
    seen = sorted(set(np.unique(grams).tolist()) - {SPACE, DIGIT, MARK, OTHER})
    compact = np.full(256, OTHER, dtype=np.int64)
    compact[[SPACE, DIGIT, MARK]] = [SPACE, DIGIT, MARK]
    compact[seen] = 4 + np.arange(len(seen))
    return compact, 4 + len(seen)


def fit(counts: list[tuple[str, int, int]], most_bytes: int = MODEL_BYTES) -> Model | None:
    """counts: (language, gram code in base 256, occurrences)."""
    languages = sorted({x[0] for x in counts})
    if not languages:
        return None
    where = {x: k for k, x in enumerate(languages)}
    lang = np.array([where[x[0]] for x in counts], dtype=np.int64)
    code, n = np.array([x[1] for x in counts], dtype=np.int64), np.array([x[2] for x in counts], dtype=np.float64)
    grams = np.stack([(code >> (8 * (DEPTH - k))) & 255 for k in range(DEPTH + 1)], axis=1)
    compact, width = _symbols(grams)
    grams = compact[grams]
    levels = []
    for depth in range(DEPTH + 1):
        contexts = np.zeros(len(code), dtype=np.int64)
        for k in range(DEPTH - depth, DEPTH):
            contexts = contexts * width + grams[:, k]
        levels.append(np.unique(contexts, return_inverse=True))
    sizes = np.cumsum([len(used) for used, _ in levels]) * width * len(languages) * 4 + np.array([4 * width**d for d in range(DEPTH + 1)])
    fitting = np.flatnonzero(sizes <= most_bytes)
    if not len(fitting):
        raise ValueError(f"{len(languages)} languages of {width} symbols don't fit a table of {most_bytes} bytes")
    deepest = int(fitting[-1])
    # Price of every symbol after no context, then after each longer one; `place` has the row of each context of a depth.
    table = np.empty((sum(len(used) for used, _ in levels[: deepest + 1]), width, len(languages)), dtype=np.float32)
    place, filled = np.zeros(1, dtype=np.int64), 0
    for depth, (used, own) in enumerate(levels[: deepest + 1]):
        shorter = place[used % (width ** max(depth - 1, 0))]
        for k in range(len(languages)):
            mine = lang == k
            exact = np.bincount(own[mine] * width + grams[mine, DEPTH], weights=n[mine], minlength=len(used) * width).reshape(len(used), width)
            total, kinds = exact.sum(axis=1, keepdims=True), (exact > 0).sum(axis=1, keepdims=True)
            below = table[shorter, :, k] if depth else np.full((1, width), 1.0 / width)
            scale = np.maximum(total + kinds, 1)
            table[filled : filled + len(used), :, k] = np.where(exact > 0, exact / scale, np.where(total > 0, kinds / scale * below, below))
        # A context that no language has seen shares the row of its suffix.
        known = np.tile(place, width) if depth > 1 else np.zeros(width**depth, dtype=np.int64)
        known[used] = filled + np.arange(len(used))
        place, filled = known, filled + len(used)
    np.log2(table, out=table)
    np.negative(table, out=table)
    symbols = compact[RAW]
    apart = np.log2(np.bincount(symbols, minlength=width)[symbols])
    return Model(languages, symbols, apart, width, deepest, place.astype(np.int32), table.reshape(-1, len(languages)))


def learnable(docs: DataFrame) -> Column:
    return F.col("lang").isNotNull() & F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in slices(batches):
        texts: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(_grams(RAW[np.frombuffer(text, dtype=np.uint8)], 256))
        for lang, own in texts.items():
            grams, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n.astype(np.int64))], schema=schema)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on about sample_rows whole texts of each language; only the grams of that sample come to the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")).filter(learnable(docs))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, sample_rows / n))) for k, n in sorted(sizes.items()))), F.col("lang"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.filter(place < share).select("lang", "text")
    grams = chosen.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return fit(list(zip(*(grams.column(k).to_pylist() for k in range(3)), strict=True)))


_LETTER = re.compile(r"[A-Za-z]")


def predict(model: Model | None, text: str | None) -> tuple[str, float, float]:
    """Language, score, bits per byte of the best tree."""
    if model is None or not text or not (_LETTER.search(text) or any(c.isalpha() for c in text)):
        return UNKNOWN, 0.0, 0.0
    data = text.encode("utf-8", "surrogatepass")
    bits = model.lengths(data)
    best = int(bits.argmin())
    weight = np.exp2(-(bits - bits[best]) / max(1.0, len(data) / EVIDENCE))
    return model.languages[best], float(1.0 / weight.sum()), float(bits[best] / len(data))


def _predicted(batches: Iterator[pa.RecordBatch], model: Broadcast) -> Iterator[pa.RecordBatch]:
    own = model.value
    for batch in slices(batches):
        found = [predict(own, t) for t in batch.column("text").to_pylist()]
        lang, score, bits = zip(*found, strict=True) if found else ((), (), ())
        keep = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_rows))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _predicted(b, model), "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def accepted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, most_bits: float = MOST_BITS) -> DataFrame:
    """The rows of docs, whole and with their own columns, whose text has a language and is not longer coded than most_bits per byte.

    Null text and text without a letter go, and so does every row if nothing could be learned; repeated rows are decided one by one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample_rows))
    rows, at = numbered(docs), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [predict(model.value, t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and bits <= most_bits for lang, _, bits in found], pa.bool_()))

    return rows.mapInArrow(kept, rows.schema).toDF(*docs.columns)
