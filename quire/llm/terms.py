"""Words of many texts at once, as array operations over the bytes of a batch.

Every separator here is an ASCII character and every other byte belongs to a word, so that no text is decoded. Only A to Z are
lower-cased. A null text has no words; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together, unless one text is longer.
SLICE_BYTES = 4 << 20
#: Rows of counts that a task holds before it hands them on.
HELD_ROWS = 300_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_class(*ranges: tuple[str, str]) -> np.ndarray:
    """True for the bytes of the given ASCII ranges, A to Z and a to z, and of all characters beyond ASCII."""
    inside = np.zeros(256, dtype=bool)
    inside[128:] = True
    for first, last in (("A", "Z"), ("a", "z"), *ranges):
        inside[ord(first) : ord(last) + 1] = True
    return inside


def slices_of_bytes(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about SLICE_BYTES of the column's text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def coded_words(texts: pa.Array, inside: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The code of each word, the distinct words by code (binary), and the number of words of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    member = inside[raw]
    first = member.copy()
    first[1:] &= ~member[:-1]
    heads = at[:-1][np.diff(at) > 0]
    first[heads] = member[heads]
    starts = np.flatnonzero(first)
    joined = _LOWER[raw[member]]
    ends = np.append(np.cumsum(member)[starts] - 1, len(joined)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(joined)]).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary, np.diff(np.searchsorted(starts, at))


def summed(tables: Iterable[pa.Table], keys: list[str], values: list[str]) -> Iterator[pa.RecordBatch]:
    """The tables with the values of equal keys summed, as far as HELD_ROWS at a time allow; columns in the order keys, values."""

    def together(parts: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(parts).group_by(keys).aggregate([(v, "sum") for v in values])
        return out.select([*keys, *(f"{v}_sum" for v in values)]).rename_columns([*keys, *values])

    held: list[pa.Table] = []
    size = 0
    for table in tables:
        held.append(table)
        size += table.num_rows
        if size > HELD_ROWS:
            held = [together(held)]
            size = held[0].num_rows
            if size > HELD_ROWS // 2:
                yield from held[0].combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from together(held).combine_chunks().to_batches()
