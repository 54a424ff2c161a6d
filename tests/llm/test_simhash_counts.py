"""The order of shingles in near-duplicate groups comes from counts over all documents."""

import numpy as np

from quarryline.llm import simhash


def test_common_shingles_are_counted_over_all_documents(spark):
    n, shared = 128, "one two three four five six"
    docs = spark.createDataFrame([(i, f"{shared} end{i}") for i in range(n)], "doc_id long, text string")
    rows = docs.selectExpr("doc_id", "cast(text as binary) text")
    want = simhash.shingle_set(shared.encode())
    assert np.array_equal(simhash._common(rows, 5, 42), want)
    assert len(simhash._common(rows.filter(f"doc_id < {n - 1}"), 5, 42)) == 0
