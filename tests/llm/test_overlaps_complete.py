"""Every pattern of replaced words that verification accepts is found."""

from itertools import combinations

from keystrata.llm import decontamination


def test_all_accepted_substitutions_are_found(spark):
    # items of n words, whole; 16 words out of 30, the other words of the document being its own
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (*range(5, 17), 30)}
    rows, wanted = [], set()
    for n, item in items.items():
        at, m = (7, 16) if n == 30 else (0, n)
        most = max(k for k in range(m) if m - k >= 0.8 * m)
        for k in range(most + 2 if m < 13 else most + 1):
            for replaced in combinations(range(m), k):
                text = ["before", *item[at : at + m], "after"]
                for place in replaced:
                    text[place + 1] = "other"
                rows.append((len(rows), " ".join(text)))
                if k <= most:
                    wanted.add((len(rows) - 1, n, m - k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["n_equal"]) for r in decontamination.overlaps(docs, bench).collect()} == wanted


def test_an_item_cut_off_by_an_end_of_the_document_is_found(spark):
    item = [f"w{k}" for k in range(16)]
    docs = spark.createDataFrame([(1, " ".join(item[3:])), (2, " ".join(item[:13])), (3, " ".join(item[2:15])), (4, " ".join(item[4:])), (5, "a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a b c d e")], "item_id long, text string")
    assert {tuple(r) for r in decontamination.overlaps(docs, bench).collect()} == {(1, 7, 16, 13, -3), (2, 7, 16, 13, 0), (3, 7, 16, 13, -2), (5, 8, 5, 4, 0)}
