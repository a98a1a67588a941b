import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    from tabulare.session import ship_package

    ship_package(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted(docs.collect(), key=lambda r: r.doc_id)


LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(60_000))      # about 700 kB


@pytest.fixture(scope="session")
def odd(spark, docs):
    """NULLs in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    data = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35),
            (2, "", "en", "a", 0), (3, None, None, None, None), (None, "alpha beta gamma delta epsilon zeta", "en", "b", 35),
            (None, None, None, "b", None), (4, "   \t\n ", "en", "b", 6), (5, LONG, "en", "a", len(LONG)),
            (6, LONG, "en", None, len(LONG)), (7, "mail bob@example.org or +1 (017) 555-7713 now", "en", "", 45),
            (8, "café \U0001f600 4845168114407329 1.2.3.4 999.1.1.1", "fr", "b", 38)]
    df = spark.createDataFrame(data, DDL)
    clash = ["size", "key", "target", "epochs", "row", "k", "first", "kind", "spans", "score", "fp", "cut", "extra", "_source", "_key",
             "_size", "_text", "_mark", "mark", "base", "rank", "vec_id", "page_id", "seg"]
    for i, c in enumerate(clash):
        df = df.selectExpr("*", f"{i} AS `{c}`")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
