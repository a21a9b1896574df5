"""Words of UTF-8 bytes as numpy arrays: places and 64-bit hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quillrank.llm.common import HASH_BASE, HASH_INVERSE, powers

#: Bytes of texts worked on at a time.
CHUNK = 1 << 20
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
SPACE = np.array([b in b"\t\n\x0b\x0c\r " for b in range(256)])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x + np.uint64(0x632BE59BD9B4E019 * (salt + 1) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each run [start, end) of values, whatever stands before it."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), HASH_BASE), out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(len(values) + 1, HASH_INVERSE)[start])


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of bytes (parted by ASCII white space, A-Z as a-z)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    return start, end, run_hashes(LOWER[data].astype(np.uint64) + np.uint64(1), start, end)


#: Masks of the first 0 to 8 bytes of a number, and the longest word hashed eight bytes at a time, with a number for each length.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SHORT = 64
_LENGTHS = mix(np.arange(_SHORT + 1, dtype=np.uint64), 6)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and another hash of the words that ``words`` finds, from eight bytes at a time (longer words by ``run_hashes``)."""
    edge = np.flatnonzero(np.diff(((data - np.uint8(9)) < 5) | (data == 32), prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    lower = data.tobytes().lower()
    eight = np.ndarray(len(data), "<u8", lower + bytes(8), strides=(1,))
    size = end - start
    hashed = mix((eight[start] & _MASKS[np.minimum(size, 8)]) ^ _LENGTHS[np.minimum(size, _SHORT)])
    left = np.flatnonzero((size > 8) & (size <= _SHORT))
    for at in range(8, _SHORT, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        hashed[left] = mix(hashed[left] ^ (eight[start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)]))
    long = np.flatnonzero(size > _SHORT)
    if len(long):
        hashed[long] = run_hashes(np.frombuffer(lower, np.uint8).astype(np.uint64) + np.uint64(1), start[long], end[long])
    return start, hashed


def chunks(documents: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Some texts at a time, and the number of the first."""
    at = 0
    while at < len(documents):
        end, size = at, 0
        while end < len(documents) and (size < most or end == at):
            size += len(documents[end]) + 1
            end += 1
        yield at, documents[at:end]
        at = end
