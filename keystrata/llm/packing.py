"""Packing token sequences by best-two-fit (operator 3).

A document is its token ids and an end id. Only documents longer than the capacity are cut, into
pieces of the capacity and a shorter last one. Best-two-fit fills a sequence greedily with the
longest pieces that still fit, then takes out its smallest piece for as long as two unpacked pieces
fill the widened gap more tightly.

Only lengths matter to that choice, and there are at most `capacity` of them. So the choice is made
on the histogram of lengths: one filled sequence is a pattern of lengths that repeats while the
counts allow it, and a pattern uses up at least one length or leaves fewer of it than the pattern
needs. The plan is bounded by the capacity, not by the corpus. Pieces find their places by their
rank within their length: a running number within (task, length), plus the pieces of that length
in earlier tasks. The pieces, without their ids, are written to the shared folder first, so ranks
stay the same when tasks are retried, and no task ever gathers all pieces of a frequent length.

Null and empty texts are documents of the end id alone. Repeated rows are documents of their own.
Empty input gives no pieces. Every column of the input but the text is kept; names that clash with
new columns make the new ones end in underscores.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_name, ship, steps, stored

CAPACITY, END_ID = 4096, 1
CACHED_WORDS, CACHED_PIECES, CACHED_LENGTH = 200_000, 50_000, 40


class PieceIds(dict):
    """Pre-token in the tokenizer's byte alphabet -> its ids as little-endian uint32 bytes."""

    def __init__(self, model, ids: int):
        super().__init__()
        self.tokenize = model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(ids)]

    def made(self, piece: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.tokenize(piece)])

    def __missing__(self, piece: str) -> bytes:
        ids = self.made(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class WordIds(dict):
    """Word -> its ids as little-endian uint32 bytes, for a tokenizer that never joins words.

    Its pre-tokenizer keeps no match across white space, its normalizer composes nothing across it,
    so the ids of a text are those of its words in order. Words of Latin-1 characters, which need no
    composition, are lower-cased and split here and only the model is called; all others go through
    the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        steps_of = json.loads(self.tokenizer.to_str())
        self.split = None
        if [n["type"] for n in steps_of["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            split, level = steps_of["pre_tokenizer"]["pretokenizers"]
            if (split["type"], split["behavior"], split["invert"], level["type"], level["use_regex"], level["add_prefix_space"]) == ("Split", "Removed", True, "ByteLevel", False, False):
                self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.pieces = PieceIds(self.tokenizer.model, self.tokenizer.get_vocab_size())
        self.alphabet = {c: "".join(map(_byte_alphabet().__getitem__, chr(c).encode())) for c in range(256)}

    def __missing__(self, word: str) -> bytes:
        if self.split is not None and max(word, default="") < "\u0100" and "<|" not in word:
            word_ = word.lower()
            if word_.isalpha():  # one pre-token, which only this word's entry keeps
                ids = self.pieces.made(word_ if word_.isascii() else word_.translate(self.alphabet))
            elif not word.isascii() or not word.isprintable():
                ids = b"".join([self.pieces[p.translate(self.alphabet)] for p in self.split(word_)])
            else:
                ids = b"".join([self.pieces[p] for p in self.split(word_)])
        else:
            ids = self.whole(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        self.clear()
        self.pieces.clear()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is not None and "<|" not in text and _is_latin_1(text):
            # fewer different words: in lower case, and without a lone full stop or comma at the end
            text = _LAST_STOP(r" \g<0>", text.lower())
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


#: A stop after a letter or digit and before white space is a pre-token of its own.
_LAST_STOP = re.compile("[.,](?<=[a-z0-9\xdf-\xf6\xf8-\xff][.,])(?=[ \n]|\\Z)").sub


def _is_latin_1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=1)
def _byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself, or from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def two_that_fit(available: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two available lengths of the largest sum over more_than and at most room."""
    lengths = np.flatnonzero(available[: min(room, len(available) - 1) + 1])
    lengths = lengths[lengths < room]
    if not len(lengths):
        return None
    below = np.maximum.accumulate(np.where(available > 0, np.arange(len(available)), 0))  # largest available length up to each
    partner = below[np.minimum(room - lengths, lengths)]
    alone = (partner == lengths) & (available[lengths] < 2)
    partner[alone] = below[lengths[alone] - 1]
    sums = np.where(partner > 0, lengths + partner, 0)
    k = int(sums.argmax())
    return (int(lengths[k]), int(partner[k])) if sums[k] > more_than else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> how often in one sequence) and the number of sequences of each."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:
        need: dict[int, int] = {}
        gap, k = capacity, len(lengths)
        while gap and (k := bisect_right(lengths, gap, 0, k)):
            length = lengths[k - 1]
            n = min(int(left[length]), gap // length)
            need[length] = n
            gap -= n * length
            k -= 1
        available = None
        while gap:
            if available is None:
                available = left.copy()
                for length, n in need.items():
                    available[length] -= n
            smallest = min(need)
            if (two := two_that_fit(available, gap + smallest, smallest)) is None:
                break
            for length, d in ((smallest, -1), (two[0], 1), (two[1], 1)):
                need[length] = need.get(length, 0) + d
                available[length] -= d
                if not need[length]:
                    del need[length]
            gap += smallest - sum(two)
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        lengths = [x for x in lengths if left[x]]
        out.append((need, times))
    return out


class Places:
    """Rank within a length -> (sequence, offset), for all lengths of a plan."""

    RANK_BITS = 44

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        rows, used, first = [], {}, 0
        for need, times in patterns:
            offset = 0
            for length in sorted(need, reverse=True):
                rank = used.get(length, 0)
                rows.append(((length << self.RANK_BITS) + rank, rank, first, times, offset))
                used[length] = rank + need[length] * times
                offset += length * need[length]
            first += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys, self.rank, self.first, self.times, self.offset = (np.ascontiguousarray(c) for c in table.T)

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, (length << self.RANK_BITS) + rank, "right") - 1
        nth = rank - self.rank[k]
        return self.first[k] + nth % self.times[k], self.offset[k] + nth // self.times[k] * length


def numbered(length_column: str, names: tuple[str, str]):
    """Adds the task's number and each row's running number among the task's rows of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            nth = []
            for length in b.column(b.schema.get_field_index(length_column)).to_pylist():
                nth.append(seen.get(length, 0))
                seen[length] = nth[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * b.num_rows, pa.int32()), pa.array(nth, pa.int64())], names=[*b.schema.names, *names])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: the input's other columns, piece, start, length, ids_crc32 and, if asked for, ids."""
    keep = [c for c in docs.columns if c != text]
    made: list[tuple[str, T.DataType]] = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        made.append(("ids", T.ArrayType(T.LongType())))
    names = [clean_name(keep, n) for n, _ in made]
    task, nth = (clean_name([*keep, *names], n) for n in ("task", "nth"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, (_, t) in zip(names, made, strict=True)] + [T.StructField(task, T.IntegerType()), T.StructField(nth, T.LongType())])
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = word_ids(tokenizer_path)
        for batch in batches:
            for part in steps(batch, text):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(part.column(part.schema.get_field_index(text)).to_pylist()):
                    whole = of.ids(t) + end
                    for k, at in enumerate(range(0, len(whole), step)):
                        own = whole[at : at + step]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(own) // 4)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4").astype(np.int64))
                kept = part.select(keep).take(pa.array(row, pa.int64())) if keep else None
                columns = [*(kept.columns if kept is not None else ()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    ship(docs.sparkSession)
    number = numbered(names[2], (task, nth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from number(cut(batches))
        finally:  # workers outlive tasks; the cache would stay in their memory
            word_ids(tokenizer_path).forget()
            pa.default_memory_pool().release_unused()

    return docs.select(*(f"`{c}`" for c in [*keep, text])).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of `pieces`, each with its sequence_id and its offset there."""
    cut = stored(pieces(docs, tokenizer_path, text, capacity, end_id, with_ids), "pieces")
    *out, task, nth = cut.columns
    length = out[len(docs.columns) - 1 + 2]
    t, l, base = (clean_name(cut.columns, c) for c in ("of_task", "of_length", "before"))
    counts = cut.groupBy(F.col(task).alias(t), F.col(length).alias(l)).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy(l).agg(F.sum("n")).collect()}  # at most `capacity` rows
    places = Places(plan(histogram, capacity))
    earlier = counts.select(t, l, (F.sum("n").over(Window.partitionBy(l).orderBy(t)) - F.col("n")).alias(base))
    ranked = cut.join(earlier, (F.col(task) == F.col(t)) & (F.col(length) == F.col(l)))
    ranked = ranked.select(*(F.col(f"`{c}`") for c in out), (F.col(nth) + F.col(base)).alias(base))
    sequence, offset = (clean_name(out, n) for n in ("sequence_id", "offset"))
    schema = T.StructType([*(cut.schema[c] for c in out), T.StructField(sequence, T.LongType()), T.StructField(offset, T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (length, base))
            s, o = places.of(lengths, ranks) if b.num_rows else (lengths, ranks)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in out), pa.array(s, pa.int64()), pa.array(o, pa.int64())], names=[*out, sequence, offset])

    return ranked.mapInArrow(place, schema)
