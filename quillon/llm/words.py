"""Vectorised hashing of words and word windows, straight from UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses these
bytes inside a longer character, so this equals splitting by code points.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that mixes all bits (Steele, Lea and Flood, 2014)."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_AS_IS = np.arange(256, dtype=np.uint8)
_FOLD = _AS_IS.copy()
_FOLD[65:91] += 32
#: Bytes of a word that are hashed eight at a time; longer words go through BLAKE2.
_LONG = 64
_LENGTH = splitmix(np.arange(_LONG + 1, dtype=np.uint64))
_ODD = U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] (uint8), every eight bytes mixed into all bits before the next."""
    held = np.zeros(len(data) + 8, dtype=np.uint8)
    held[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=held, strides=(1,))  # the eight bytes from each offset
    size = ends - starts
    short = np.minimum(size, _LONG)
    out = splitmix((_LENGTH[short] + U(seed)) ^ (eight[starts] & _MASK[np.minimum(size, 8)]))
    done, rest = 8, np.flatnonzero(size > 8)
    while done < _LONG and len(rest):
        part = eight[starts[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]
        out[rest] = splitmix(out[rest] ^ part)
        done += 8
        rest = rest[size[rest] > done]
    for i in rest.tolist():
        digest = hashlib.blake2b(held[starts[i] : ends[i]].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text. fold: A-Z as a-z."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < 1 << 20):
            held += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(texts[at:end]), dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = IS_WORD[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        if len(starts):
            hashes.append(span_hashes(_FOLD[data] if fold else data, starts, ends))
            bounds = np.cumsum([len(t) + 1 for t in texts[at:end]])
            counts[at:end] = np.diff(np.searchsorted(starts, bounds), prepend=0)
        at = end
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), counts


_LETTER = np.array([chr(b).isalnum() for b in range(128)] + [True] * 128)


def term_hashes(text: bytes, prefix: int = 5) -> np.ndarray:
    """Hashes of a text's terms (letters and digits, A-Z as a-z) and of their first prefix bytes."""
    data = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    inside = _LETTER[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    long = starts[ends - starts >= prefix]
    return np.concatenate((span_hashes(data, starts, ends), span_hashes(data, long, long + prefix, seed=1)))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of width words; windows across texts are the caller's to leave out.

    Runs of 1, 2, 4 ... words are mixed in pairs, so that no arithmetic
    relation between words carries over to runs.
    """
    n = len(words)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    power, span = splitmix(words + U(seed)) if seed else words, 1  # hashes of span words
    out, held = None, 0  # hashes of the first held words of each window
    while True:
        if width & span:
            own = power[held : held + n - width + 1]
            out = own if out is None else splitmix(out * _ODD + own)
            held += span
        if 2 * span > width:
            return splitmix(out + U(width))
        power = splitmix(power[:-span] * _ODD + power[span:])
        span *= 2


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Indexes of the windows that lie within one text."""
    n = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(n)
    return at[at + width <= ends]
