from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture
def odd_docs(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, "Hello World", "x", 1), (2, "hello world", "y", None), (3, None, None, 3), (4, "", "z", 4), (None, "HELLO world", "n", 5), (None, "alone here", "n", 6),
        (5, "É É", "x", 7), (6, "é É", "x", 8), (7, " \n\t", "w", 9), (8, "long word " * 4000, "l", 10), (8, "long word " * 4000, "l", 10), (9, "a b c d e f g h", "q", 11), (10, "👍 emoji 👍 text with ▁ and \u2028", "q", 12),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, fingerprint int")
