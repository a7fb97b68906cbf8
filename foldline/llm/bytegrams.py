"""Byte strings as arrays of gram codes, for the byte context models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

END = 255  # no UTF-8 text holds this byte: it stands before a text, as context, and after it, as its end
CHUNK = 1 << 20


def framed(data: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All strings in one array, each after ``depth`` END bytes and before one; and where each begins, and the end."""
    mark = bytes([END])
    joined = np.frombuffer(b"".join(x for d in data for x in (mark * depth, d, mark)), np.uint8)
    return joined, np.concatenate(([0], np.cumsum([len(d) + depth + 1 for d in data]))).astype(np.int64)


def gram_codes(data: np.ndarray, depth: int) -> np.ndarray:
    """For each byte from position ``depth`` on, itself (lowest eight bits) and the ``depth`` bytes before it."""
    n = len(data) - depth
    codes = data[:n].astype(np.uint64)
    for k in range(1, depth + 1):
        codes <<= np.uint64(8)
        codes |= data[k:k + n]
    return codes


def pieces(data: list[bytes], depth: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owner) over all strings in pieces of about ``chunk`` bytes: the gram of each byte and end, and whose it is.

    A string longer than a piece goes on in the next one, with its context.
    """
    begin = 0
    while begin < len(data):
        stop, size = begin, 0
        while stop < len(data) and (size == 0 or size + len(data[stop]) <= chunk):
            size += len(data[stop])
            stop += 1
        joined, starts = framed(data[begin:stop], depth)
        for at in range(0, len(joined) - depth, chunk):
            codes = gram_codes(joined[at:at + chunk + depth], depth)
            places = np.arange(at, at + len(codes)) + depth
            owner = np.searchsorted(starts, places, side="right") - 1
            own = places - starts[owner] >= depth
            yield codes[own], begin + owner[own]
        begin = stop
