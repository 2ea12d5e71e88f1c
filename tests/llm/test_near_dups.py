"""Near-duplicate classes and benchmark overlaps against brute force."""

import random

import numpy as np
import pytest

from keystrata.llm import components as components_module
from keystrata.llm import decontamination, near_dups


def shingles(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_classes(rows, t=0.8):
    """Rows of an id are one document, with the links of each of its texts."""
    of = {}
    for i, text in rows:
        if i is not None:
            of.setdefault(i, set()).add(shingles(text))
    up = {i: i for i in of}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(of)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            for x in of[a]:
                for y in of[b]:
                    both = len(x & y)
                    if x and both >= t * (len(x) + len(y) - both):
                        up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def corpus(seed, groups=6, copies=14):
    r = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{r.randrange(300)}" for _ in range(r.choice([30, 80, 200]))]
        for _ in range(copies):
            rows.append((i := i + 1, " ".join(edited(r, base, r.randrange(0, 7)))))
        rows.append((i := i + 1, "\n ".join(base)))
        rows.append((i := i + 1, " ".join(base[: int(len(base) * 0.9)])))
        rows.append((i := i + 1, " ".join(base + base[:10])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,in_one_task", [(1, True), (2, False), (3, False)])
def test_classes_are_the_brute_force_components(spark, seed, in_one_task, monkeypatch):
    if not in_one_task:
        monkeypatch.setattr(near_dups, "LOCAL_PAIRS", -1)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("in_one_task", [True, False])
def test_a_chain_is_one_class_though_its_ends_differ(spark, in_one_task, monkeypatch):
    if not in_one_task:
        monkeypatch.setattr(near_dups, "LOCAL_PAIRS", -1)
    base = [f"w{i}" for i in range(100)]
    rows = [(k, " ".join([f"x{j}" for j in range(3 * k)] + base[3 * k :])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    assert got == brute_classes(rows) and set(got.values()) == {0}


def test_edge_cases(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "a"), (6, " a "), (7, "a b c d"), (8, "a b c d"), (9, "a b c d e"), (None, "a"), (10, "one two three four five six"), (10, "another text of that id"), (11, "another text of that id\none two three four five six"), (12, "same " * 400), (13, "same " * 300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, id string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12, 13: 12} == brute_classes(rows)
    assert near_dups.classes(docs.limit(0)).count() == 0
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    # both texts of id 10 stay, and the row without an id is a copy of 5
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 2, 3, 4, 5, 7, 9, 10, 10, 11, 12]
    clash = near_dups.one_of_each(docs.withColumnsRenamed({"id": "at"}))
    assert clash.columns == ["doc_id", "text", "at"] and clash.count() == 11
    assert near_dups.one_of_each(docs.limit(0)).count() == 0


def test_a_document_of_two_texts_joins_their_classes(spark):
    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "xyz"]
    rows = [(7, words[0]), (9, words[1]), (5, words[0]), (5, words[1]), (6, words[2]), *[(8, words[2])] * 50, (8, None)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 7: 5, 9: 5, 6: 6, 8: 6} == brute_classes(rows)


@pytest.mark.parametrize("in_one_task", [True, False])
def test_fragments_of_one_document_and_hot_leaders(spark, in_one_task, monkeypatch):
    # many fragments of a text, alike only to their neighbours, under a leader that has all of them
    if not in_one_task:
        monkeypatch.setattr(near_dups, "LOCAL_PAIRS", -1)
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    monkeypatch.setattr(components_module, "BLOCK", 2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))] + [(1 + k, " ".join(base[k % 3 : 100 + k % 3 - 2 * (k // 3)])) for k in range(24)]
    rows += [(100 + k, " ".join(base[20:80] + [f"o{k}"] * 3)) for k in range(12)]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("families,led", [(3, False), (1, True)])
def test_families_of_similar_documents_take_one_round(spark, families, led, monkeypatch):
    # documents of a common text and some of a few passages, so that many share passages and few are linked
    monkeypatch.setattr(near_dups, "LOCAL_PAIRS", -1)
    if led:  # the way of buckets that are too many to pair
        monkeypatch.setattr(near_dups, "EACH", -1)
        monkeypatch.setattr(near_dups, "AT_ONCE", -1)
    calls, real = [], near_dups._next_buckets
    monkeypatch.setattr(near_dups, "_next_buckets", lambda *a: calls.append(1) or real(*a))
    r = random.Random(8)
    rows = []
    for f in range(families):
        base = [f"b{f}.{i}" for i in range(100)]
        passages = [[f"p{f}.{k}.{i}" for i in range(8)] for k in range(8)]
        for _ in range(6 if led else 30):
            rows.append((len(rows), " ".join(base + [w for k in r.sample(range(8), 4) for w in passages[k]])))
    got = {x["doc_id"]: x["class_id"] for x in near_dups.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows) and len(set(got.values())) > families
    assert led or len(calls) == 1


@pytest.mark.parametrize("ok", [True, False])
def test_pairs_of_a_bucket_that_sizes_exclude(spark, ok):
    # 2 and 3 share at most 60 + 5 of 100 and 100 shingles, 89 are needed; 1 and 2 at most 85 + 5
    rows = [(7, 1, False, 100, 85, 10), (7, 2, ok, 100, 90, 5), (7, 3, False, 100, 60, 30)]
    found = near_dups._paired(spark.createDataFrame(rows, "bucket long, b long, ok boolean, nb long, both long, common int"), 0.8)
    assert [tuple(x) for x in found.collect()] == [(1, 2)]


def test_prob_min_hash_estimates_probability_jaccard():
    r = np.random.default_rng(5)
    names = r.integers(1, 1 << 63, 300, np.int64).astype(np.uint64)
    a, b = r.integers(1, 6, 300).astype(float), r.integers(1, 6, 300).astype(float)
    a[:60], b[240:] = 0, 0
    text = np.concatenate((np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)))
    with np.errstate(over="ignore"):
        s = near_dups.prob_min_hash(text, np.concatenate((names[a > 0], names[b > 0])), np.concatenate((a[a > 0], b[b > 0])), 2, 4096)
    both = (a > 0) & (b > 0)
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    assert abs((s[0] == s[1]).mean() - exact) < 4 * np.sqrt(exact * (1 - exact) / 4096)


@pytest.mark.parametrize("registers", [16, 12])
def test_repeated_shingles_and_many_arrivals_at_once_change_no_register(registers, monkeypatch):
    r = np.random.default_rng(9)
    names = r.integers(1, 1 << 63, 400, np.int64).astype(np.uint64)
    text = np.repeat(np.arange(6), [1, 2, 5, 40, 350, 2])
    order = np.concatenate((np.arange(400), r.integers(0, 400, 3000), np.zeros(5000, int)))  # the text of one shingle 5000 times
    expected = np.zeros((7, registers), np.uint64)
    with np.errstate(over="ignore"):
        for t in range(6):
            earliest = [np.inf] * registers
            for s in names[text == t]:
                time, n = 0.0, 0
                while time < max(earliest):
                    n += 1
                    bits = near_dups.mix(np.array([s + np.uint64(n) * near_dups._GOLD]))
                    time -= np.log(((bits[0] >> np.uint64(11)).astype(float) + 1) * 2.0**-53)
                    k = int(near_dups.mix(bits ^ near_dups._GOLD)[0] % np.uint64(registers))
                    if time < earliest[k]:
                        earliest[k], expected[t, k] = time, s
        rounds, mix = [], near_dups.mix
        monkeypatch.setattr(near_dups, "mix", lambda x: rounds.append(x.size) or mix(x))
        assert (near_dups.prob_min_hash(text[order], names[order], None, 7, registers) == expected).all()
        assert (near_dups.prob_min_hash(text, names, np.ones(400), 7, registers) == expected).all()
    assert len(rounds) < 40 and max(rounds) < 10_000


@pytest.mark.parametrize("most", [10, 0])
def test_documents_are_not_shuffled_to_drop_few_of_them(spark, most, monkeypatch):
    monkeypatch.setattr(near_dups, "CORPUS_IDS", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, " ".join(f"w{i % 20 if i < 24 else i}_{k}" for k in range(30))) for i in range(60)]
        kept = near_dups.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(x["doc_id"] for x in kept.collect()) == [i for i in range(60) if not 20 <= i < 24]
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (most > 0, most == 0)


def test_overlaps_tolerate_substitutions_and_leave_others_alone(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    item = [word() for _ in range(40)]
    short, tiny = [word() for _ in range(7)], [word() for _ in range(3)]
    other = lambda n: [word() for _ in range(n)]
    swapped = [w if k % 7 != 3 else word() for k, w in enumerate(item)]
    half = [w if k % 2 else word() for k, w in enumerate(item)]
    rows = [
        (1, " ".join(other(30) + item + other(5))), (2, ", ".join(other(3) + swapped).upper()), (3, " ".join(other(60))), (4, " ".join(half)), (5, " ".join(other(4) + short + other(9))),
        (6, " ".join(tiny + other(20))), (7, None), (8, ""), (9, " ".join(item[10:30])), (10, " ".join(item[:9] + other(40))), (None, " ".join(item)), (1, " ".join(item)), (11, " ".join(item * 40)),
    ]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, item long")
    bench = spark.createDataFrame([(70, " ".join(item)), (71, " ".join(short)), (72, " ".join(tiny)), (73, None), (70, " ".join(item))], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.overlaps(docs, bench).collect()}
    assert got == {(1, 70), (2, 70), (5, 71), (9, 70), (None, 70), (11, 70)}
    best = {x["doc_id"]: tuple(x)[2:] for x in decontamination.overlaps(docs, bench).collect()}
    assert best[11] == (40, 40, 0) and best[1][:2] == (40, 40)
    assert sorted(x["doc_id"] or 0 for x in decontamination.clean(docs, bench).collect()) == [3, 4, 6, 7, 8, 10]
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0 and decontamination.overlaps(docs.limit(0), bench).count() == 0


def test_cleaning_keeps_columns_of_any_name_and_rows_without_an_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, item, 1, "x"), (None, "of its own", 2, "y"), (None, None, 3, "z"), (4, item, 4, "x"), (4, "the same id", 5, "x"), (5, "clean", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, overlapping_id long, key string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontamination.clean(docs, bench)
    assert out.columns == docs.columns and sorted(r["overlapping_id"] for r in out.collect()) == [2, 3, 6]


def test_a_large_benchmark_is_taken_in_blocks(spark, monkeypatch):
    # 20 items, one of them twice and one id with two texts; a document of 100,000 words holds some of them
    items = [(i, " ".join(f"i{i}x{k}" for k in range(16 + i))) for i in range(20)] + [(3, " ".join(f"i3x{k}" for k in range(19))), (4, " ".join(f"second{k}" for k in range(30)))]
    long = " ".join(["filler", "words"] * 25_000 + items[7][1].split() + ["more", "of", "them"] * 16_000 + items[12][1].split())
    rows = [(1, long), (2, items[0][1] + " x " + items[-1][1]), (3, "nothing of it"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = sorted(map(tuple, decontamination.overlaps(docs, bench).collect()))
    assert {r[:2] for r in wanted} == {(1, 7), (1, 12), (2, 0), (2, 4)}
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = decontamination.overlaps(docs, bench)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        physical = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # documents are cut into blocks of items, and none of their words go through an exchange
    assert plan.count("Generate explode") > 3 and "SortMergeJoin" not in physical
    for line in physical.splitlines():
        if "Exchange hashpartitioning(doc" in line:
            break
    else:
        raise AssertionError("the verified hits are shuffled by document")
