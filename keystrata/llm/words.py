"""Word and window hashes of Arrow text columns, in numpy, without a Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes between words: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LANES = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))  # of the windows' polynomials, odd
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
_STEP = 1 << 18  # words hashed at once
LONG = 64  # bytes from which a word is hashed by itself


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int, lane: int) -> np.ndarray:
    """64 bits of each word: eight bytes at a time are mixed into a state that begins with key, lane and length.

    Mixing is a bijection and not linear, so equal hashes of different words are a matter of chance. Words
    of LONG bytes and more are digested by BLAKE2b.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = np.empty(len(start), np.uint64)
    salt = mix(np.array([key & 0xFFFFFFFFFFFFFFFF], np.uint64) ^ _LANES[lane])[0]
    for at in range(0, len(start), _STEP):
        begin, size = start[at : at + _STEP], (end[at : at + _STEP] - start[at : at + _STEP])
        state = mix(size.astype(np.uint64) * _GOLD ^ salt)
        own = np.arange(len(begin))
        for k in range(0, LONG, 8):
            own = own[size[own] > k]
            if not len(own):
                break
            block = eight[begin[own] + k] & _MASK[np.minimum(size[own] - k, 8)]
            state[own] = mix(state[own] ^ block) if lane == 0 else mix(state[own] + block * _GOLD)
        for w in np.flatnonzero(size >= LONG).tolist():
            digest = hashlib.blake2b(data[begin[w] : begin[w] + size[w]].tobytes(), digest_size=8, salt=bytes([lane]) * 8, key=key.to_bytes(16, "little")).digest()
            state[w] = int.from_bytes(digest, "little")
        out[at : at + _STEP] = state
    return out


def _polynomial(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """The rolling polynomial of every run of `size` values, by doubling."""
    done, of, width, power, run, rest = 0, None, 1, base, h.copy(), size
    while True:
        if rest & 1:
            if of is None:
                of, done = run.copy(), width
            else:
                m = len(h) - done - width + 1
                of = of[:m] * power + run[done : done + m]
                done += width
        rest >>= 1
        if not rest:
            return of
        m = len(run) - width
        run = run[:m] * power + run[width : width + m]
        width *= 2
        power = power * power


class Words:
    """The words of a batch of texts: hashes, byte ranges, and where each text's words begin.

    A word is a maximal run of bytes that are not white space; nulls and empty texts have none. `key`
    chooses the hash; with `wide` there is a second one, independent of the first.
    """

    def __init__(self, texts: pa.Array, key: int = 0, wide: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = at - at[0]
        gap = _SPACE[self.data]
        size = len(self.data)
        first = np.ones(size, bool)  # a word may begin here: after white space or at a text's start
        first[1:] = gap[:-1]
        first[at[:-1][at[:-1] < size]] = True
        last = np.ones(size, bool)
        last[:-1] = gap[1:]
        ends = at[1:][at[1:] > 0] - 1
        last[ends[ends < size]] = True
        self.start = np.flatnonzero(first & ~gap)
        self.end = np.flatnonzero(last & ~gap) + 1
        self.bounds = np.searchsorted(self.start, at)  # words of text i: bounds[i] to bounds[i + 1]
        self.lanes = [_hash_words(self.data, self.start, self.end, key, lane) for lane in range(1 + wide)]
        self.at = at
        self.counts = np.diff(self.bounds)
        self.texts = n

    @property
    def hash(self) -> np.ndarray:
        return self.lanes[0]

    def windows(self, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `size` words within a text, and the text of each, in order."""
        h = self.lanes[lane]
        if len(h) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        of = _polynomial(h, size, _BASES[lane])
        text = np.repeat(np.arange(self.texts), self.counts)
        inside = text[: len(of)] == text[size - 1 :]
        return mix(of[inside]), text[: len(of)][inside]

    def text_hash(self, of: np.ndarray | None = None) -> np.ndarray:
        """128 bits of a BLAKE2b digest of the words of each text (or of some), as rows of two."""
        some = np.arange(self.texts) if of is None else of
        digests = (hashlib.blake2b(b" ".join(self.data[a:b].tobytes().split()), digest_size=16).digest() for a, b in zip(self.at[some].tolist(), self.at[some + 1].tolist(), strict=True))
        return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """As windows, but a text of fewer words than `size` has one shingle: all its words."""
        h, text = self.windows(size)
        short = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(short):
            whole = mix(self.text_hash(short)[:, 0])
            h, text = np.concatenate((h, whole)), np.concatenate((text, short))
        return h, text
