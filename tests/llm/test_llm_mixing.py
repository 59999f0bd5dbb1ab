"""The mix beside a plain version of its targets, and what its sample must keep to."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tagspark.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Sharing by weight, turn by turn, until no target is above its stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def checked(docs, **options):
    """The mix's rows, after all that holds of every mix."""
    got = mixing.mixed(docs, **options).collect()
    given = [(r["doc_id"], r["source"], words(r["text"])) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = defaultdict(int)
    for _, s, n in given:
        sizes[s] += n
    want = plain_targets(dict(sizes))
    goal = sorted((str(d), n, sizes[s], round(want[s], 6)) for d, s, n in given)
    assert sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6)) for r in got) == goal
    for r in got:
        assert r["taken"] in ({0} if not r["size"] else {0, r["size"], 2 * r["size"]})
        assert r["taken"] >= r["size"] * int(r["target"] // r["source_size"] if r["source_size"] else 0)
    return got


def by_source(got):
    """(taken, target, longest) of each source, which its size tells from the others here."""
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        k = r["source_size"]
        taken[k] += r["taken"]
        target[k], longest[k] = r["target"], max(longest[k], r["size"])
    return [(taken[k], target[k], longest[k]) for k in taken]


def test_the_table(spark, docs):
    got = checked(docs)
    assert all(abs(a - b) <= longest / 2 for a, b, longest in by_source(got))
    again = mixing.mixed(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_the_order_is_that_of_a_plain_pareto_sample(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), "ab"[i % 3 % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in checked(docs)}
    u = {r["doc_id"]: r["u"] for r in mixing.sized(docs).collect()}
    for source in "ab":
        own = [r for i, r in got.items() if rows[i][2] == source]
        total, target = own[0]["source_size"], own[0]["target"]
        copies = int(target // total)
        wanted = target - copies * total
        p = wanted / sum(r["size"] for r in own if r["size"] <= wanted)
        order = sorted((r for r in own if r["size"] <= wanted), key=lambda r: (u[r["doc_id"]] / (1 - u[r["doc_id"]])) / (p / (1 - p)) if p < 1 else 0)
        first, full = set(), 0
        for r in order:
            if full + r["size"] > wanted:
                break
            full += r["size"]
            first.add(r["doc_id"])
        more = {r["doc_id"] for r in own if r["taken"] > copies * r["size"]}
        assert first <= more and len(more - first) <= 1
        assert abs(sum(r["taken"] for r in own) - target) <= 1


@pytest.mark.parametrize("slices", [5])
def test_slices_do_not_change_the_sample(spark, slices):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 17))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 50))").alias("source"))
    got = sorted(map(tuple, mixing.mixed(docs, slices=slices).collect()))
    assert got == sorted(map(tuple, mixing.mixed(docs).collect()))


def test_inclusion_follows_the_probability(spark):
    """Each document of a source with a wanted share p is taken in about that share of many mixes."""
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(5 + id % 3))").alias("text"), F.expr("concat('s', id % 2)").alias("source"))
    got = mixing.mixed(docs).groupBy("target", "size").agg(F.avg(F.col("taken") / F.col("size")).alias("rate"), F.first("source_size").alias("n")).collect()
    assert all(abs(r["rate"] - r["target"] / r["n"]) < 0.05 for r in got)


def test_odd_rows(spark, odd, nothing):
    got = checked(odd)
    assert len(got) == odd.count()
    assert mixing.mixed(nothing).collect() == []
    assert mixing.mixed(nothing).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_one_long_document_and_equal_rows(spark):
    rows = [(1, "w " * 1000, "a"), (2, "w", "a"), *[(3, "x y", "b")] * 40, (None, "", "c"), (5, None, "c"), (6, "w", None)]
    got = checked(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["taken"] for r in got if r["doc_id"] == 3) == sorted(r["taken"] for r in checked(spark.createDataFrame(rows[::-1], SCHEMA)) if r["doc_id"] == 3)
