"""Texts as blocks of word codes: one row holds many texts' words as numbers
into the block's own list of distinct words, so that a corpus-wide table of
words meets each block once a word, not once an occurrence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: Bytes of text in a block; one longer text makes a block of its own.
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 1 << 16
#: Bits of a number that count within a block; a block that holds more takes
#: the numbers of several.
WITHIN = 23
SPACE, BREAK = 0x20, 0x0A


def byte_table(breaks: bytes, spaces: bytes) -> bytes:
    """For bytes.translate: A-Z lower-cased, ``spaces`` as SPACE, ``breaks`` as BREAK."""
    out = bytearray(range(256))
    out[0x41:0x5B] = range(0x61, 0x7B)
    for b in spaces:
        out[b] = SPACE
    for b in breaks:
        out[b] = BREAK
    return bytes(out)


def words_of(raw: bytes) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(codes, distinct words, number of breaks before each word) of translated text."""
    data = np.frombuffer(raw, np.uint8)
    gap = (data == SPACE) | (data == BREAK)
    edge = np.flatnonzero(np.concatenate(([True], gap)) != np.concatenate((gap, [True])))
    start, end = edge[::2], edge[1::2]
    ends = np.concatenate(([0], np.cumsum(end - start)))
    kind, offset = (pa.string(), np.int32) if len(raw) < 1 << 31 else (pa.large_string(), np.int64)
    words = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(offset)), pa.py_buffer(data[~gap])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.cast(pa.string()), np.searchsorted(np.flatnonzero(data == BREAK), start)


def squeeze(numbers: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers).tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Numbers:
    """Block numbers of one task, from its partition's own range."""

    def __init__(self):
        self.next = TaskContext.get().partitionId() << 20

    def take(self, size: int) -> int:
        """The number of a block whose own counts stay below ``size``."""
        number = self.next
        self.next += 1 + (size >> WITHIN)
        return number
