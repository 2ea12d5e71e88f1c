"""Language identification with hyperdimensional profiles (operator 2).

Each letter symbol has a random bipolar vector of DIMENSIONS components, from a fixed seed. The
vector of an n-gram binds (multiplies) its letters' vectors, each permuted (rotated) by its place.
A document bundles (adds) the vectors of all its n-grams; a language's prototype bundles the
unit-length vectors of its training documents; a document takes the language whose prototype has
the largest cosine with it, ties to the smaller name.

Letters are lower-cased; anything else is a gap, runs of gaps count as one. ASCII letters have a
symbol each, others share 37 by code point. Texts are processed whole.

Null texts and texts without a letter are `und` with score 0. The score is the cosine, at least 0.

The prototypes are fitted on at most about `rows_per_language` distinct labelled texts of each
language (all of them where there are fewer), chosen by a hash of the text, and on the `most_languages`
languages of most distinct texts; only the fit is bounded so. Components are summed as scaled integers,
so any task order gives the same prototypes.

Rows are independent: repeated rows give repeated results. An empty table gives no rows. Without a
labelled training row there is no prototype, and all documents are `und` with score 0. Columns of the
input stay; a clashing lang_pred or score gets underscores behind its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clean_name, held_out, ship, steps

DIMENSIONS, SEED, GRAM = 1024, 20260101, 3
SYMBOLS = 64
UNDETERMINED = "und"
ROWS_PER_LANGUAGE, MOST_LANGUAGES = 3000, 1000
SCALE = 1 << 20
PIECE = 1 << 20  # characters of one text encoded at once


class Encoder:
    """Texts to (n-gram ids, counts) and to bundled vectors."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.letters = rng.integers(0, 2, (SYMBOLS, DIMENSIONS), dtype=np.int8) * 2 - 1
        self.slot = np.full(SYMBOLS**GRAM, -1, np.int32)
        self.vectors = np.empty((4096, DIMENSIONS), np.int8)
        self.filled = 0
        self.symbol = np.zeros(0x110000, np.uint8)
        ascii_ = np.arange(26, dtype=np.uint8) + 1
        self.symbol[ord("a") : ord("z") + 1] = ascii_
        for cp in range(128, 0x110000):
            if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
                self.symbol[cp] = 27 + cp % 37

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """Distinct n-gram ids, their counts, and whether the text has a letter."""
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        tail, any_letter = np.zeros(1, np.uint8), False
        for at in range(0, len(text), PIECE):
            raw = text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass")
            s = self.symbol[np.frombuffer(raw, np.uint32)]
            any_letter = any_letter or bool(s.any())
            s = np.concatenate((tail, s, np.zeros(int(at + PIECE >= len(text)), np.uint8)))
            s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int32)
            if len(s) < GRAM:
                tail = s.astype(np.uint8)
                continue
            g = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
            i, n = np.unique(g, return_counts=True)
            ids.append(i)
            counts.append(n)
            tail = s[-2:].astype(np.uint8)
        if len(ids) > 1:
            all_ids, where = np.unique(np.concatenate(ids), return_inverse=True)
            return all_ids, np.bincount(where, np.concatenate(counts)).astype(np.int64), any_letter
        return (ids[0], counts[0], any_letter) if ids else (np.empty(0, np.int32), np.empty(0, np.int64), any_letter)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Places in `vectors` of these n-grams; new ones are bound first."""
        new = ids[self.slot[ids] < 0]
        if len(new):
            while self.filled + len(new) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.empty_like(self.vectors)))
            bound = np.ones((len(new), DIMENSIONS), np.int8)
            for place in range(GRAM):
                letter = new // SYMBOLS ** (GRAM - 1 - place) % SYMBOLS
                bound *= np.roll(self.letters, place, axis=1)[letter]
            self.vectors[self.filled : self.filled + len(new)] = bound
            self.slot[new] = np.arange(self.filled, self.filled + len(new))
            self.filled += len(new)
        return self.slot[ids]

    def unit(self, text: str | None) -> np.ndarray | None:
        """The text's vector, of length 1; None without letters."""
        if not text:
            return None
        ids, counts, any_letter = self.grams(text)
        if not any_letter or not len(ids):
            return None
        rows = self.rows(ids)  # may replace self.vectors
        v = counts.astype(np.float32) @ self.vectors[rows].astype(np.float32)
        norm = float(np.sqrt(np.dot(v, v)))
        return v / norm if norm else None


_encoder: Encoder | None = None


def encoder() -> Encoder:
    global _encoder
    _encoder = _encoder or Encoder()
    return _encoder


@dataclass(frozen=True)
class Prototypes:
    """Languages in order of name and their unit vectors; the size is languages x DIMENSIONS."""

    languages: tuple[str, ...]
    vectors: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Prototypes:
    """Prototypes from the rows with a language; the caller leaves out what is held out."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    # distinct texts, of which the sample is taken: copies leave it as large
    counted = rows.select("lang", F.xxhash64("text").alias("copy")).distinct().groupBy("lang").count()
    counts = {r["lang"]: r["count"] for r in counted.orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return Prototypes((), np.empty((0, DIMENSIONS), np.float32))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, rows_per_language / n)) for k, n in counts.items()], "lang string, share double")
    rows = rows.join(F.broadcast(shares), "lang")  # at most most_languages rows
    # chosen by text, and each text once: a large group of copies can't fill the sample
    place = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1_000_003))
    chosen = rows.where(place < F.col("share") * 1_000_003).groupBy(F.xxhash64("text").alias("copy"), "lang").agg(F.first("text").alias("text")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums = encoder(), {}
        for batch in batches:
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (v := of.unit(t)) is not None:
                    sums[k] = sums.get(k, 0) + np.rint(v * SCALE).astype(np.int64)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(v)], names=["lang", "dim", "value"])

    ship(docs.sparkSession)
    parts = chosen.mapInArrow(run, "lang string, dim int, value long")
    total: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "dim").agg(F.sum("value").alias("value")).collect():  # languages x DIMENSIONS rows
        total.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["dim"]] = r["value"]
    names = tuple(sorted(total))
    vectors = np.array([total[k] / max(np.linalg.norm(total[k]), 1.0) for k in names], np.float32).reshape(-1, DIMENSIONS)
    return Prototypes(names, vectors)


def predict(docs: DataFrame, prototypes: Prototypes, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), keep_text: bool = False) -> DataFrame:
    """docs, without or with the text, and the predicted language and score of each row."""
    keep = [c for c in docs.columns if keep_text or c != text]
    names = [clean_name(keep, c) for c in out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    languages, vectors = prototypes.languages, prototypes.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder()
        for batch in batches:
            for part in steps(batch, text):
                lang, score = [], []
                for t in part.column(part.schema.get_field_index(text)).to_pylist():
                    v = of.unit(t)
                    if v is None or not languages:
                        lang.append(UNDETERMINED)
                        score.append(0.0)
                        continue
                    cos = vectors @ v
                    k = int(cos.argmax())
                    lang.append(languages[k])
                    score.append(min(1.0, max(0.0, round(float(cos[k]), 6))))
                columns = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    ship(docs.sparkSession)
    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text]))).mapInArrow(run, schema)


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that may be learned from: crc32 of the id modulo 3 is not 1."""
    return docs.where(~F.coalesce(held_out(doc_id), F.lit(False)))


def accepted(lang: Column, score: Column, least_score: float) -> Column:
    return (lang != UNDETERMINED) & (score >= least_score)
