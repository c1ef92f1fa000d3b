"""Words of many texts at a time as Arrow strings, and long texts cut at word boundaries into chunks that overlap by whole words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte is: part of a word, between words, or the end of a piece, over which no run of words goes.
WORD, BLANK, END = 0, 1, 2
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_kinds(blanks: bytes, ends: bytes = b"") -> np.ndarray:
    """The kind of each byte where blanks part words, ends part pieces and all else belongs to words."""
    kinds = np.full(256, WORD, np.uint8)
    kinds[list(blanks)] = BLANK
    kinds[list(ends)] = END
    return kinds


def words_of(texts: pa.Array, kinds: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(each word, lower-cased in A-Z, with one blank behind; its piece; its text), in order. Runs of words within a piece are slices of the array's bytes."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = kinds[data]
    kind[at[1:] - 1] = END  # the sign behind each text
    inside = kind == WORD
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    blank = keep & ~inside
    data = np.where(inside, LOWER[data], np.uint8(32))[keep]
    offsets = np.concatenate([[0], np.flatnonzero(blank[keep]) + 1]).astype(np.int64)
    last = np.flatnonzero(blank) - 1  # the last byte of each word
    piece = np.cumsum(kind == END, dtype=np.int64)[last]
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return words, piece, np.searchsorted(at, last, side="right") - 1


def chunks(text: bytes, size: int, kinds: np.ndarray, before: int = 0, after: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """(number, carried before, carried behind, bytes): a text cut into chunks of about `size` bytes, never within a word.

    Each chunk owns the words that start in its own stretch and carries up to `before` words in front of it and `after` words behind
    it; those are other chunks' own, so every word is owned once, however often it is carried.
    """
    inside = bytes(np.flatnonzero(kinds == WORD).tolist())
    word = re.compile(b"[" + re.escape(inside) + b"]+")
    back: list[int] = []  # starts of the last words of what has been cut
    at = k = 0
    while at < len(text) or not k:
        end = min(len(text), at + size)
        if 0 < end < len(text) and kinds[text[end - 1]] == WORD and kinds[text[end]] == WORD:
            end = word.match(text, end).end()
        stop, carried = end, 0
        for m in word.finditer(text, end) if after else ():
            stop, carried = m.end(), carried + 1
            if carried == after:
                break
        front = back[-before:] if before else []
        yield k, len(front), carried, text[front[0] if front else at : stop]
        if before:
            tail = max(at, end - 64 * before)
            own: list[int] = []
            while True:  # the last words of the stretch, looked for from ever further in front
                if tail > at and kinds[text[tail - 1]] == WORD and kinds[text[tail]] == WORD:
                    m = word.match(text, tail)
                    begin = m.end()
                else:
                    begin = tail
                own = [m.start() for m in word.finditer(text, begin, end)]
                if len(own) >= before or tail == at:
                    break
                tail = max(at, end - 8 * (end - tail))
            back = (back + own)[-before:]
        at, k = end, k + 1


def bounded(batches, text_at: int, kinds: np.ndarray, size: int, before: int = 0, after: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.LargeStringArray, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, row of each text, words, piece and text of each, whether it is owned): whole short texts together, long ones chunk by chunk, about `size` bytes at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        low = 0
        while low < batch.num_rows:
            if lengths[low] > size:
                text = batch.column(text_at)[low].as_py().encode()
                for _, front, behind, body in chunks(text, size, kinds, before, after):
                    words, piece, _ = words_of(pa.array([body], pa.large_binary()).cast(pa.large_string()), kinds)
                    own = np.ones(len(words), bool)
                    own[:front] = False
                    own[len(words) - behind :] = False
                    yield batch, np.array([low]), words, piece, np.zeros(len(words), np.int64), own
                low += 1
                continue
            total = np.cumsum(lengths[low:])
            large = np.flatnonzero(lengths[low:] > size)
            high = low + max(1, int(np.searchsorted(total, size, side="right")))
            high = min(high, low + int(large[0])) if len(large) else high
            words, piece, text = words_of(batch.column(text_at).slice(low, high - low), kinds)
            yield batch, np.arange(low, high), words, piece, text, np.ones(len(words), bool)
            low = high
