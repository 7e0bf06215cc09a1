"""Hashes of all words of a buffer at once, eight bytes at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from casegrid.llm.packed import mixed
from casegrid.llm.text_tables import SPACES

#: Longer words are hashed one by one.
SHORT = 64
#: Bytes of text that are looked at at once.
PIECE = 2_000_000
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [ord(c) for c in SPACES])
_CUT = re.compile(b"[%s]" % SPACES.encode())
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word, in order; words are `[^\\x20\\x09-\\x0D]+`."""
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, np.uint8)], prepend=True, append=True))
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=1)
    hashes = mixed(size.astype(np.uint64))
    for k in range(0, min(int(size.max(initial=0)), SHORT), 8):
        these = np.flatnonzero(size > k) if k else slice(None)
        block = eight[start[these] + k] & _MASKS[np.minimum(size[these] - k, 8)]
        hashes[these] = mixed(hashes[these] * _FOLD + block)
    for k in np.flatnonzero(size > SHORT):
        hashes[k] = xxhash.xxh3_64_intdigest(data[start[k] : start[k] + size[k]])
    return start, hashes


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word of all texts, in order; long texts are cut at white space, so that buffers stay small."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(held: list[tuple[int, bytes]]) -> None:
        start, hashes = word_hashes(b"\n".join(t for _, t in held))
        ends = np.cumsum([len(t) + 1 for _, t in held])
        found.append((np.array([i for i, _ in held])[np.searchsorted(ends, start, "right")], hashes))

    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > PIECE and (cut := _CUT.search(text, at + PIECE)):
            if held:
                flush(held)
                held, size = [], 0
            flush([(i, text[at : cut.start()])])
            at = cut.start()
        held.append((i, text[at:]))
        size += len(text) - at
        if size > PIECE:
            flush(held)
            held, size = [], 0
    if held:
        flush(held)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))
