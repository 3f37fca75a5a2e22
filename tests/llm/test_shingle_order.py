"""The order of the shingles comes from every text."""

import numpy as np

from tandemline.llm import jaccard


def test_every_text_is_counted(spark):
    rows = [(i, f"a{i} b{i} c{i} same old words here now") for i in range(40)] + [(98, None), (99, "")]
    got = jaccard.frequencies(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    want = np.concatenate([np.unique(jaccard.shingles(t, 5)) for _, t in rows])
    assert got.sum() == len(want)
    assert got.max() >= 40
