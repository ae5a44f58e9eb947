"""Word blocks: texts cut into words by columns, and arrays packed for the way between tasks.

A task turns the texts it reads into blocks of bounded size. What blocks tell each
other (counts of words, of word pairs) leaves as one packed row per block and hash
bucket, so a word however frequent crosses once per block, and no bucket is
hotter than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
SPACE = 0x20


def byte_table(spaces: list[int]) -> bytes:
    """Translation of UTF-8 bytes: A-Z to lower case, ``spaces`` (ASCII) to the blank."""
    out = bytearray(range(256))
    out[0x41:0x5B] = bytes(range(0x61, 0x7B))
    for c in spaces:
        out[c] = SPACE
    return bytes(out)


def cut(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of texts of at most ``size`` bytes together, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield start, stop
        start = stop


def words_of(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of texts without nulls, in order, and the number of each text."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = memoryview(data)[ends[0] : ends[-1]].tobytes().translate(table) if data is not None and len(texts) else b""
    clean = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(ends - ends[0]) if len(ends) else np.zeros(1, np.int64)), pa.py_buffer(data))
    parts = pc.split_pattern(clean, " ")
    words, at = parts.flatten(), parts.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)
    upto = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[at - at[0]]
    return words.filter(real), np.diff(upto)


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them, compressed; ascending ones as differences."""
    numbers = np.asarray(numbers, np.uint64)
    rising = len(numbers) > 1 and bool((numbers[1:] >= numbers[:-1]).all())
    if rising:
        numbers = np.concatenate([numbers[:1], np.diff(numbers)])
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width, rising]) + zstandard.ZstdCompressor(level=1).compress(numbers.astype(f"<u{width}").tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The array of ``pack``, as unsigned 64-bit numbers."""
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), f"<u{data[0]}").astype(np.uint64)
    return np.cumsum(out, dtype=np.uint64) if data[1] else out


def pack_words(words: list[str]) -> bytes:
    """Words, none of which holds a line feed."""
    return zstandard.ZstdCompressor(level=1).compress("\n".join(words).encode())


def unpack_words(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(data).decode().split("\n")


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Stable order by bucket, and (bucket, start, stop) of its runs."""
    order = np.argsort(bucket, kind="stable")
    of = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
    stops = np.append(starts[1:], len(of))[: len(starts)]
    return order, [(int(of[a]), int(a), int(b)) for a, b in zip(starts, stops, strict=True)]
