"""Links of documents that differ in shingles of many occurrences."""

from keystrata.llm import near_dups


def test_a_repeated_footer_hides_no_link(spark):
    rows = []
    for k in range(60):
        body, footer = [f"b{k}x{j}" for j in range(144)], [f"f{k}x{j}" for j in range(25)]
        rows += [(2 * k, " ".join(body)), (2 * k + 1, " ".join(body + footer * 200))]  # 140 of 169 shingles are in both
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dups.classes(docs).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}
