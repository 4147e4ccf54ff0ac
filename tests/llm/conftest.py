import random

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(60_000))


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, equal texts, clashing extra columns."""
    same = prose(1, 120)
    rows = [(None, "a text without an id " * 3), (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, same), (6, same), (7, prose(2, 80)),
            (7, prose(2, 80)), (8, "é" * 3000), (9, "x\ny\n"), (10, "short"), (11, prose(1, 119) + " changed")]
    cols = ("row", "key", "span", "kept", "ids", "spans", "n_words", "bucket", "shard", "slot", "rank", "version", "node", "bands", "range", "guest", "ctx", "p", "h1")
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame([(*r, *("extra",) * len(cols)) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs_sf(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
