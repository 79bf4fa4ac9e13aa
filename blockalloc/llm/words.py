"""Words of whole Arrow columns of text, without a Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from blockalloc.llm.packed import binary_parts

#: Bytes of words once A-Z are lower-cased: digits, a-z and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a column one after another: the different ones, each word's place among them, and its row.

    A word is a maximal run of digits, letters a-z (A-Z are lower-cased, no others) and
    characters beyond ASCII; as UTF-8 marks those by its bytes alone, bytes are enough.
    Null has no words.
    """
    data, offsets = binary_parts(texts)
    data = LOWER[data]
    inside = WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[heads] = inside[heads]  # a word doesn't go on in the next row
    starts = np.flatnonzero(begins)
    kept = data[inside]
    ends = np.r_[np.cumsum(inside)[starts] - 1, len(kept)].astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())])
    coded = found.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1
