from helpers import rows
from pyspark.sql import functions as F

from tagspark.functions import joins


def test_salted_join_equals_plain_join(spark):
    big = spark.range(3000).select((F.col("id") % 3 == 0).alias("hot"), "id").withColumn("k", F.when(F.col("hot"), 0).otherwise(F.col("id") % 50))
    side = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(joins.salted_join(big, side, ["k"], how)) == rows(big.join(side, ["k"], how))


def test_lookup_past_the_bound_gives_the_same_rows(spark, monkeypatch):
    big = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    side = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    broadcast = rows(joins.lookup(big, side, ["k"], "left"))
    monkeypatch.setattr(joins, "fits", lambda *_: False)
    assert rows(joins.lookup(big, side, ["k"], "left")) == broadcast


def test_top_per_group_with_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("g"), F.col("id").alias("v"))
    got = joins.top_per_group(df, ["g"], [F.col("v").desc()], 5)
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append(r.v)
    assert rows(got, "g", "v") == {(g, v) for g, vs in want.items() for v in sorted(vs)[-5:]}


def test_group_percentile_merges_equal_values(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 1, 1, 2, 9, 10]] + [("b", 4)], "g string, v bigint")
    assert rows(joins.group_percentile(df, ["g"], "v", 0.5, "m")) == {("a", 1.5), ("b", 4.0)}


def test_fits_stops_past_the_limit(spark):
    assert joins.fits(spark.range(10), 10) and not joins.fits(spark.range(11), 10)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_salted_side_is_shuffled_however_small_its_files_look(frame):
    big = frame([("a", i) for i in range(50)] + [(None, 9)], "k string, v long")
    side = frame([("a", 1), ("b", 2)], "k string, w long")
    joined = joins.salted_join(big, side, ["k"], "left")
    assert "Broadcast" not in _plan(joined)
    assert joined.count() == 51 and joined.filter("w = 1").count() == 50


def test_only_hot_keys_are_copied_into_slots(frame, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    big = frame([("hot", i) for i in range(40)] + [("cold", 1), ("cold", 1), ("lone", 2), (None, 3), (None, 3)], "k string, v long")
    side = frame([("hot", 1), ("cold", 2), ("cold", 3), (None, 4)], "k string, w long")
    rows = lambda df: sorted(map(str, df.collect()))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(joins.skewed_join(big, side, ["k"], how)) == rows(big.join(side, "k", how))


def test_a_whitelist_never_goes_through_the_driver(frame):
    from tagspark.operators import reads as R

    mols = frame([("s", "AAAA", "U", "F", 1, 1), ("s", "AAAC", "U", "F", 2, 2), ("s", "GGGG", "U", "F", 1, 1)], "sampleId string, CELL string, UMI string, FEATURE string, reads long, weight long")
    listed = frame([("AAAA",), ("TTTT",)], "CELL string")
    assert "Broadcast" not in _plan(R.whitelist_corrections(mols, listed))
    assert [tuple(r) for r in R.correct_to_whitelist(mols, listed).collect()] == [("s", "AAAA", "U", "F", 3, 3)]


def test_order_lines_past_the_bound_never_go_through_the_driver(spark, frame, tmp_path, monkeypatch):
    from tagspark.plans import roles

    tables = {
        "lineitem": ([(1, 7, 5.0), (1, 8, 1.0), (2, 7, 2.0), (3, 9, 1.0), (None, 7, 1.0)], "l_orderkey long, l_partkey long, l_quantity double"),
        "part": ([(7, "Brand#1"), (8, "Brand#2")], "p_partkey long, p_brand string"),
        "orders": ([(1, "1-URGENT"), (2, "2-HIGH"), (3, "5-LOW")], "o_orderkey long, o_orderpriority string"),
    }
    for name, (given, schema) in tables.items():
        frame(given, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    small = roles.order_lines(spark, str(tmp_path))
    assert small.count() == 3
    monkeypatch.setattr(joins, "fits", lambda *_: False)
    large = roles.order_lines(spark, str(tmp_path))
    assert "Broadcast" not in _plan(large) and rows(large) == rows(small)


def test_large_tables_are_dealt_over_tasks_by_their_rows(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    assert joins.dealt(df, ["k"], 1000) is df
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    many = joins.dealt(df, ["k"], 1000)
    assert many.rdd.getNumPartitions() == 128 and rows(many) == rows(df)


def test_states_of_large_counts_are_read_in_more_tasks_with_the_same_rows(counts, frame, monkeypatch):
    from tagspark.operators import states as X

    given = counts([("s", f"c{i % 40}", f"t{i // 40}", i % 7) for i in range(400)])
    grouping = frame([(f"t{i}", "s", f"f{i % 3}") for i in range(1, 10)], "tag string, sample string, identity string")
    refs = frame([("t0",)], "tag string")
    plain = rows(X.states_from_counts(given, grouping, refs, small=True))
    own = rows(X.combine_tags(given, grouping, True))
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    states = X.states_from_counts(given, grouping, refs, small=True)
    assert states.rdd.getNumPartitions() == 64 and rows(states) == plain
    assert rows(X.combine_tags(given, grouping, True)) == own


def test_sums_of_large_tables_leave_a_group_in_one_task_and_its_rows_in_slots(frame, monkeypatch):
    df = frame([("hot", f"i{i % 2}", f"c{i}", 1) for i in range(200)] + [("a", "i0", "c0", 5), (None, "i1", None, 7), (None, "i1", None, 7)], "g string, i string, c string, n long")
    plain = rows(joins.added_up(df, ["g", "i"], ["n"], ["g"], 10))
    monkeypatch.setattr(joins, "TASK_ROWS", 10)
    dealt = joins.added_up(df, ["g", "i"], ["n"], ["g"], 1000)
    assert rows(dealt) == plain == rows(df.groupBy("g", "i").agg(F.sum("n").alias("n")))
    assert dealt.rdd.getNumPartitions() == 128
    assert _plan(dealt.groupBy("g").count()).count("Exchange") == 2


def test_rows_that_meet_nothing_are_not_shuffled(spark):
    from tagspark.functions import joins
    from tagspark.sources.sinks import stage

    big = spark.range(20_000).selectExpr("cast(id % 5000 as string) AS k", "IF(id % 7 = 0, NULL, 's') AS s", "id")
    side = stage(spark.range(40).selectExpr("cast(id * 5 as string) AS k", "'s' AS s", "id AS v"), "side")
    got, want = joins.sparse_join(big, side, ["k", "s"]), big.join(side, ["k", "s"], "left")
    assert sorted(map(str, got.select("k", "s", "id", "v").collect())) == sorted(map(str, want.select("k", "s", "id", "v").collect()))
    assert joins.sparse_join(big, side.filter("v < 0"), ["k", "s"]).filter("v is null").count() == 20_000
