"""Copies of texts leave what is learned of a language as it is."""

import numpy as np

from keystrata.llm import language_id


def test_a_language_of_copies_is_learned_from_all_its_texts(spark):
    texts = [(f"le chat numéro {chr(97 + k % 26)}{chr(97 + k // 26)} est sur la table", "fr") for k in range(40)] + [(f"the cat {chr(97 + k)} sat on the mat", "en") for k in range(20)]
    once = spark.createDataFrame(texts, "text string, lang string")
    copied = once.crossJoin(spark.range(200).select()).unionByName(once)
    a, b = (language_id.fit(d, rows_per_language=60) for d in (once, copied))
    assert a.languages == b.languages == ("en", "fr") and np.array_equal(a.vectors, b.vectors)
