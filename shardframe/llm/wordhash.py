"""Vectorised 64-bit hashes of words and of windows of words, over many texts at a time.

A word's hash mixes its bytes eight at a time; a window's is a tree over its words' hashes, mixed at every node. None is a
sum or a polynomial, so that patterns of repeated letters or words do not cancel out. A lane is one of several independent
hash functions.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 1 << 18
#: Words longer than this many bytes are hashed one by one.
LONG = 256
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
EMPTY = np.zeros(0, np.uint64)
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: What of 8 bytes belongs to a word with 0 to 8 bytes left.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a node from those of its left and right part."""
    return mix(a * ODD[1] + (b ^ (b >> np.uint64(29))) * ODD[2])


def digest(data: bytes, lane: int = 0) -> int:
    """A signed 64-bit hash of bytes."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=bytes([lane])).digest(), "little", signed=True)


def hashes_of(own: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int) -> np.ndarray:
    """The hash of each run of bytes own[first:last]."""
    size = last - first
    data = np.concatenate([own, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(own) + 1,), "<u8", data, 0, (1,))  # the 8 bytes from each place on
    h = mix(size.astype(np.uint64) + np.uint64(int(ODD[0]) * (lane + 1) % 2**64))
    left, at, who = size, first, slice(None)
    while len(at):
        h[who] = pair(h[who], eight[at] & MASKS[np.minimum(left, 8)])
        more = np.flatnonzero((left > 8) & (left <= LONG) if isinstance(who, slice) else left > 8)
        left, at = left[more] - 8, at[more] + 8
        who = more if isinstance(who, slice) else who[more]
    for k in np.flatnonzero(size > LONG):
        h[k] = np.uint64(digest(own[first[k] : last[k]].tobytes(), lane) % 2**64)
    return h


def word_hashes(data: list[bytes], lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and where each text's words begin (one more than there are texts)."""
    buffer = b"\n".join(data) + b"\n"
    a = np.frombuffer(buffer, np.uint8)
    hashes, starts, at = [EMPTY], [np.zeros(0, np.int64)], 0
    while at < len(a):
        end = min(at + BLOCK, len(a))
        while end < len(a) and not SEPARATOR[a[end - 1]]:  # blocks end with a separator
            back = np.flatnonzero(SEPARATOR[a[max(at, end - 256) : end]])
            end = max(at, end - 256) + int(back[-1]) + 1 if len(back) else min(end + 256, len(a))
        own = a[at:end]
        apart = SEPARATOR[own]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], apart]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]  # a block begins a word or a separator, and ends with a separator
        hashes.append(hashes_of(own, first, last, lane))
        starts.append(first + at)
        at = end
    begin = np.cumsum([0] + [len(d) + 1 for d in data])
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` words; windows that reach into the next text are the caller's to drop.

    Windows of 1, 2, 4, ... words are made from two halves each; one of ``width`` from those that width's bits name."""
    out = [EMPTY]
    for at in range(0, len(words) - width + 1, BLOCK):
        own = words[at : at + BLOCK + width - 1]
        n, level, size, done, found = len(own) - width + 1, own, 1, 0, None
        while True:
            if width & size:
                part = level[done : done + n]
                found = mix(part + ODD[0]) if found is None else pair(found, part)
                done += size
            if 2 * size > width:
                break
            level, size = pair(level[: len(level) - size], level[size:]), 2 * size
        out.append(found)
    return np.concatenate(out)


def text_hash(words: np.ndarray, lane: int = 0) -> int:
    """The signed 64-bit hash of a whole sequence of words."""
    return digest(words.astype("<u8").tobytes(), lane)
