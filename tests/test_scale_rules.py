"""One rule at every size: no result is lost, and no answer changes, past a limit."""

import pytest
from pyspark.sql import functions as F

from tagspark.functions import score
from tagspark.operators import panels as P
from tagspark.sources import sinks
from tagspark.sources.tables import read_counts


def test_a_cutoff_that_no_table_entry_reaches_is_answered(frame):
    df = frame([(5, 1), (10**6, 100), (3, 600)], "n long, r long")
    got = [r[0] for r in df.select(score.reaches(df.n, df.r, 99.99999999999999)).collect()]
    assert got == [False, True, False]
    assert score.count_to_reach(99.99999999999999, 1) is not None


def test_codes_are_compared_over_the_shorter(frame):
    distance = lambda *tags: P.min_pairwise_hamming(frame([(x,) for x in tags], "tag string")).first()[0]
    assert distance("ACGT", "ACGTA") == 0
    assert distance("ACGT", "ACTTA", "GGCCAAA") == 1
    assert distance("AAAA", "TTTT", "AATT") == 2
    assert distance("AAA", "CCCCC") == 3
    assert distance("AAAA") is None and distance("AAAA", None, "AAAA") is None


def test_the_nearest_codes_of_a_hundred_thousand(spark):
    """Two letters for each bit and its complement keep codes two apart; one planted pair is closer."""
    bits = F.lpad(F.conv(F.col("id").cast("string"), 10, 2), 17, "0")
    codes = spark.range(100_000).select(F.concat(F.translate(bits, "01", "AC"), F.translate(bits, "01", "GT")).alias("tag"))
    assert P.min_pairwise_hamming(codes).first()[0] == 2
    near = codes.unionByName(codes.limit(1).select(F.overlay("tag", F.lit("T"), F.lit(1), F.lit(1)).alias("tag")))
    assert P.min_pairwise_hamming(near).first()[0] == 1


def test_a_large_counts_file_is_split(spark, tmp_path):
    path = tmp_path / "counts.csv"
    path.write_text("sampleId,cellId,tag,umiCount\n" + "".join(f"s,c{i},t,{i}\n" for i in range(200_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        counts = read_counts(spark, str(path))
        assert counts.rdd.getNumPartitions() > 2 and counts.count() == 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sinks.shared_dir(Session())
