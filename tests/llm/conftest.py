import os

import pytest

SF = os.environ.get("TAGSPARK_TEST_SF", "/root/testdata/sf0.001")
LONG = " ".join(f"w{i % 977} {i} some-more, words." for i in range(30000))

ODD = [
    None,
    "",
    " \n\t ",
    "a",
    "one two",
    "Ünïcode ß İstanbul \u00a0 ﬁ 日本語 \U0001f600 ١٢٣ naïve'll don't \x1c x",
    LONG,
    "same line\nsame line\n\nsame line\n" * 30,
    "mail a@b.c_e@f.g x.y@z-1.co.uk. ip 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 +1 (555) 123-4567 4539 1488 0343 6467 4539148803436467",
    "<|endoftext|> and <|startoftext|> in a text",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in each column, repeated rows, ties and columns that clash with what operators add."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 5) for i, t in enumerate(ODD)]
    rows += [(3, "a", "en", "s", 5), (3, "a", "en", "s", 5), (None, "one two", None, None, None), (40, ODD[6], "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    clash = {c: 7 for c in ("n_words", "kept", "fp", "key", "part", "n_tokens", "counts", "base", "_counts", "_base", "_text", "_doc", "component_id", "host", "held_out", "spans", "a.b")}
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in clash.items()})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("benchmark tables are not here")
    return spark.read.parquet(f"{SF}/documents.parquet")
