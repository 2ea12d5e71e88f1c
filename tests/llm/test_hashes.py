"""Words that defeat a polynomial hash, ids at the ends of their range, rows without an id."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from keystrata.llm import near_dups, substring_dups
from keystrata.llm.words import Words


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_word_hashes_are_of_all_bytes():
    r = random.Random(1)
    words = {"".join(r.choice("ab") for _ in range(r.randrange(1, 90))) for _ in range(4000)} | {thue_morse(2048), thue_morse(2048, "b", "a"), "x" * 63, "x" * 64, "x" * 65, "é" * 40}
    text = " ".join(sorted(words))
    with np.errstate(over="ignore"):
        w = Words(pa.array([text]), wide=True)
        again = Words(pa.array(["lead in", text])[1:], wide=True)
        other = Words(pa.array([text]), key=5)
    for lane in range(2):
        assert len(set(w.lanes[lane].tolist())) == len(words) and w.lanes[lane].tolist() == again.lanes[lane].tolist()
    assert not set(w.hash.tolist()) & set(other.hash.tolist())


def test_different_words_are_no_repeat_and_no_copy(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}"), (3, f"{x} {tail}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dups.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    one = spark.createDataFrame([(1, f"{x} a b"), (2, f"{y} a b"), (3, f"{x}  a b")], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dups.classes(one).collect()} == {1: 1, 2: 2, 3: 1}


def test_hashes_that_collide_in_the_first_pass(spark, monkeypatch):
    # with 0 or few marks everything is shared in the first pass; the second decides
    monkeypatch.setattr(substring_dups, "_MARK", 1)
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in substring_dups.remove_repeats(docs, group_bytes=900).collect()}
    seen, wanted = set(), {}
    for i, t in rows:
        words, gone = t.split(), [False] * 60
        for k in range(41):
            w = tuple(words[k : k + 20])
            gone[k : k + 20] = [True] * 20 if w in seen else gone[k : k + 20]
            seen.add(w)
        wanted[i] = (sum(gone), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    assert got == wanted


def test_two_windows_of_one_first_hash():
    class Twisted(Words):
        def windows(self, size, lane=0):
            h, text = super().windows(size, lane)
            return (h % np.uint64(3) if lane == 0 else h), text

    docs = pa.table({"at": [1, 2, 3], "id": [1, 2, 3], "t": ["a b c a b c d", "a b c", "d a b"]})
    real, substring_dups.Words = substring_dups.Words, Twisted
    try:
        with np.errstate(over="ignore"):
            g = substring_dups._Group(docs, 2, 0, True)
    finally:
        substring_dups.Words = real
    # ab, bc, ca, cd, da: each once, at its first occurrence
    assert sorted(g.first.tolist()) == [0, 1, 2, 5, 8]


def test_ids_at_the_ends_and_many_rows_without_one(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    last, first = (1 << 63) - 1, -(1 << 63)
    rows = [(last, passage), (first, passage), (0, passage)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dups.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {last: 25, first: 0, 0: 25}
    rows += [(None, f"{passage} {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "n_words")
    out = substring_dups.remove_repeats(docs, doc_id="n_words")
    assert out.columns[0] == "n_words_" and out.count() == 303
    assert out.where("n_words_ IS NULL AND n_removed >= 25").count() == 300 and out.where(f"n_words_ = {last} AND n_removed = 25").count() == 1
    # rows without an id are dealt over the groups
    ordered = substring_dups.in_order(docs, "n_words", "text")
    assert ordered.select("at").distinct().count() == 303
    ids = [r["id"] for r in ordered.orderBy("at").collect()]
    assert ids[:3] == [first, 0, last] and set(ids[3:]) == {None}
