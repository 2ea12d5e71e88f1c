"""Token counts by count-only Viterbi over a unigram vocabulary (operator 1).

Aho-Corasick (pyahocorasick) enumerates the vocabulary pieces that end at each character; dynamic
programming keeps, for each end, the best score and the number of pieces on that path, never the
path itself. Tie rules are those of the `tokenizers` Unigram model: at an end, candidates come by
ascending start (longest piece first) and only a strictly better score replaces; a character that
is no piece costs the lowest score less 10 and, with byte fallback, counts one token a UTF-8 byte.

No piece has a space mark after another character, so the lattice falls apart before each run of
space marks and at each character that no piece has; counts of the segments add up, and a bounded
cache of segments serves the frequent ones. Scores are doubles, as in `tokenizers`.

Null and empty texts have 0 tokens. Texts are processed whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import clean_name, ship, steps

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_SEGMENTS, CACHED_LENGTH = 300_000, 40


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        sp.id_to_piece(i): sp.get_score(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    }


class UnigramCounter(dict):
    """Segment -> number of tokens; a missing segment is computed and, if short, kept."""

    def __init__(self, vocabulary: dict[str, float]):
        super().__init__()
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(vocabulary.values()) - UNKNOWN_PENALTY
        known = set().union(*vocabulary)
        crossing = any(SPACE in p.lstrip(SPACE) for p in vocabulary)
        # A line end that no piece has is a cut; a vocabulary that crosses spaces has no other.
        if crossing:
            self.segments = lambda s: [s] if s else []
        elif "\n" in known:
            self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        else:
            self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+").findall

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment)
        if len(segment) <= CACHED_LENGTH:
            if len(self) >= CACHED_SEGMENTS:
                self.clear()
            self[segment] = n
        return n

    def viterbi(self, s: str) -> int:
        n = len(s)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # ends up to here are settled

        def unknown(e: int, single: bool, reached: bool) -> None:
            if single:
                return
            score = best[e - 1] + self.unknown
            if not reached or score > best[e]:
                best[e], count[e] = score, count[e - 1] + len(s[e - 1].encode("utf-8", "surrogatepass"))

        single = reached = False
        for last, (length, score) in self.automaton.iter(s):
            e = last + 1
            while done + 1 < e:  # the ends up to this match's
                done += 1
                unknown(done, single, reached)
                single = reached = False
            start = e - length
            score += best[start]
            if not reached or score > best[e]:
                best[e], count[e], reached = score, count[start] + 1, True
            single = single or length == 1
        while done < n:
            done += 1
            unknown(done, single, reached)
            single = reached = False
        return count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, self.segments(SPACE + text.replace(" ", SPACE))))


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(read_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs without the text column, with the token count of each whole text in a new column."""
    keep = [c for c in docs.columns if c != text]
    out = clean_name(keep, out)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary_path)
        try:
            for batch in batches:
                for part in steps(batch, text):
                    counts = [of.count(t) for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                    columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*keep, out])
        finally:  # workers outlive tasks; the cache would stay in their memory
            of.clear()

    ship(docs.sparkSession)
    return docs.select(*(f"`{c}`" for c in [*keep, text])).mapInArrow(run, schema)
