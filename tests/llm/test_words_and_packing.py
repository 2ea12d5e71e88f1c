"""Window hashes, packing and token counts against plain versions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import packing, queries, substring_dups, token_counts
from keystrata.llm.words import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", "a b", " a\tb\nc  d ", "é ü x y", "w " * 45, "\x1fx\x85y z"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 20])
def test_windows(size):
    with np.errstate(over="ignore"):
        hashes, text = Words(pa.array(TEXTS)).windows(size)
    wanted = [(i, tuple(w[k : k + size])) for i, w in enumerate(WORD.findall(t or "") for t in TEXTS) for k in range(len(w) - size + 1)]
    assert text.tolist() == [i for i, _ in wanted]
    by = {}
    for (_, words), h in zip(wanted, hashes.tolist(), strict=True):
        assert by.setdefault(words, h) == h
    assert len(set(by.values())) == len(by)


def test_words_of_a_slice():
    with np.errstate(over="ignore"):
        assert Words(pa.array(TEXTS)[3:6]).hash.tolist() == Words(pa.array(TEXTS[3:6])).hash.tolist()
        assert Words(pa.array([], pa.string())).texts == 0 and len(Words(pa.array([None], pa.string())).hash) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_packs_everything_once(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.plan(counts, capacity)
    used = {}
    for need, times in patterns:
        assert times > 0 and 0 < sum(k * n for k, n in need.items()) <= capacity
        for k, n in need.items():
            used[k] = used.get(k, 0) + n * times
    assert used == counts
    places = packing.Places(patterns)
    at = {}
    for length, n in counts.items():
        s, o = places.of(np.full(n, length, np.int64), np.arange(n, dtype=np.int64))
        for x in zip(s.tolist(), o.tolist(), strict=True):
            at.setdefault(x[0], []).append((x[1], length))
    assert sum(map(len, at.values())) == len(lengths)
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity


def test_two_documents_replace_the_smallest():
    # greedy takes 6 and 3, gap 1; without the 3 the gap of 4 takes 2 + 2
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0][0] == {6: 1, 2: 2}


def test_word_ids_are_the_tokenizers():
    path = queries.tokenizer_path("word_bpe_49k.json")
    of = packing.word_ids(path)
    texts = [t or "" for t in TEXTS] + ["Don't I'VE <|endoftext|>x <|start", "ÀÉÎ½²ªº ßẞ İI ΣΑΣ 3.14", "é ́x ń", "日本語 😀 text", "x" * 5000]
    for t in texts:
        assert np.frombuffer(of.ids(t), "<u4").tolist() == of.tokenizer.encode(t, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = [(i, t, 7) for i, t in enumerate(["alpha beta", None, "", "gamma " * 50, "gamma " * 50, "delta " * 333])] + [(0, "alpha beta", 7), (None, "nameless", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    out = packing.pack(docs, path, capacity=64, with_ids=True).toPandas()
    assert {"length", "length_"} <= set(out.columns)  # the input's own length column stays
    of = packing.word_ids(path)
    wanted = sorted((-1 if i is None else i, np.frombuffer(of.ids(t), "<u4").tolist() + [1]) for i, t, _ in rows)
    whole = []
    for i, part in out.fillna({"doc_id": -1}).groupby("doc_id"):
        copies = (part.piece == 0).sum()
        pieces = part.sort_values("piece").ids_crc32
        assert (part.length_ <= 64).all() and len(pieces) % copies == 0
        one = part.drop_duplicates("piece").sort_values("piece")
        whole += [(int(i), [int(x) for ids in one.ids for x in ids])] * copies
    assert sorted(whole) == wanted
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert (part.length_.cumsum() - part.length_ == part.offset).all() and part.length_.sum() <= 64
    assert packing.pack(docs.limit(0), path).count() == 0


def test_token_counts_are_the_unigram_models(spark):
    from tokenizers import Tokenizer, models, normalizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    vocabulary = token_counts.read_vocabulary(path)
    least = min(vocabulary.values())
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary.items(), *((f"<0x{i:02X}>", least) for i in range(256))], 0, True))
    model.normalizer = normalizers.Sequence([normalizers.Prepend(token_counts.SPACE), normalizers.Replace(" ", token_counts.SPACE)])
    texts = [t for t in TEXTS if t] + ["a  b\n\n  c 😀é́ zzzz", "   ", "\n", " \n x", "日本語テキスト", "unbelievable " * 300, "x" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *texts])], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    assert got == dict(enumerate([0, 0, *(len(model.encode(t, add_special_tokens=False).ids) for t in texts)]))
    clash = token_counts.token_counts(docs.withColumnRenamed("doc_id", "n_tokens"), path)
    assert clash.columns == ["n_tokens", "n_tokens_"]
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_ties_go_to_the_longest_last_piece():
    c = token_counts.UnigramCounter({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "▁ab": -3.0})
    assert c.count("ab") == 1  # all paths score -3; the candidate of the earliest start came first
    assert c.count("aé") == 1 + 2  # two bytes of a character that is no piece


def brute_repeats(rows, size):
    import hashlib

    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            w = tuple(words[k : k + size])
            if w in seen:
                gone[k : k + size] = [True] * size
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        spans, k = [], 0
        while k < len(gone):
            if gone[k]:
                e = k
                while e < len(gone) and gone[e]:
                    e += 1
                spans.append((k, e))
                k = e
            else:
                k += 1
        out.setdefault(i, []).append((len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), spans, kept if t is not None else None))
    return {i: sorted(v, key=str) for i, v in out.items()}


def test_substring_dups(spark):
    import random

    r = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(60):
        words = [r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(r.randrange(0, 40))]
        if i % 3 == 0:
            words[5:5] = passage[r.randrange(5) :]
        if i % 5 == 0:
            words += words
        rows.append((i * 7 % 61, r.choice([" ", "\n", "  "]).join(words)))
    rows += [(100, None), (101, ""), (102, " \n "), (103, rows[0][1]), (103, rows[0][1]), (103, "x " + rows[3][1]), (None, rows[6][1]), (104, "same " * 200), (105, "same " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in substring_dups.remove_repeats(docs, size=20, with_text=True).collect():
        got.setdefault(x["doc_id"], []).append((x["n_words"], x["n_removed"], x["kept_sha256"], [tuple(s) for s in x["intervals"]], x["kept_text"]))
    assert {i: sorted(v, key=str) for i, v in got.items()} == brute_repeats(rows, 20)
    assert substring_dups.remove_repeats(docs.limit(0)).count() == 0
