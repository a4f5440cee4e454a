"""Words of many texts at once as numpy arrays: places and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SPACES = bytes([0x20, *range(0x09, 0x0E)])
FNV_START, FNV_PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
LONG_WORD = 64


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Word bytes where white space alone separates, and where anything but letters, digits and non-ASCII does.
NOT_SPACE = ~byte_table(SPACES)
ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)))


def gather(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts joined in buffers of about ``most`` bytes: first and last text's number, lower-cased bytes (A-Z), and where each
    text starts in them. A text is never cut."""
    parts, sizes, first, held = [], [], 0, 0
    for k, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        parts.append(raw)
        sizes.append(len(raw) + 1)
        held += sizes[-1]
        if held >= most or k + 1 == len(texts):
            yield first, k + 1, np.frombuffer(b"\n".join([*parts, b""]), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1]))
            parts, sizes, first, held = [], [], k + 1, 0


def words(buffer: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of member bytes; the buffer ends with a byte that is no member."""
    inside = member[buffer]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words: FNV-1a, byte by byte over all words at once, then mixed; very long words by XXH64."""
    n = ends - starts
    order = np.argsort(-np.minimum(n, LONG_WORD + 1), kind="stable")
    at, size = starts[order], n[order]
    h = np.full(len(at), FNV_START, np.uint64)
    counts = len(size) - np.searchsorted(size[::-1], np.arange(LONG_WORD + 1), "right") if len(size) else np.zeros(LONG_WORD + 1, np.int64)
    for k in range(min(LONG_WORD, int(size[0]) if len(size) else 0)):
        m = int(counts[k])
        h[:m] = (h[:m] ^ buffer[at[:m] + k]) * FNV_PRIME
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(buffer[at[k] : at[k] + size[k]].tobytes(), 1)
    out = np.empty(len(h), np.uint64)
    out[order] = mix(h)
    return out
