"""Quality rules with thresholds from mergeable quantile sketches.

Fixed rules reject short and repetitive texts. For four further measures (symbols, repeated lines, repeated words,
length of words) no cutoff is fixed: each language and source gets its own, from the quartiles of its documents.

A sketch is the number of documents in each of at most a few hundred log-linear buckets: integers under 64 by
themselves, larger ones by their six leading bits, so a quantile is right to one part in 32. Sketches merge by adding
counts; those of a language's sources give the language's, and these give the corpus's, which stand in where a
group has fewer than `least` documents. Everything is DataFrame code: texts are read once, sketches are sums that
combine before the shuffle, whatever share of the rows a group holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..sources.sinks import stage
from .rows import fresh, pick

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: A group of fewer documents uses its language's sketch, a language of fewer the corpus's.
LEAST = 200
#: A document is out when it is further from the median than so many times the group's own spread on that side.
REACH = 6
#: Added to each spread: what a measure may differ by chance in one text (one repeated line of three is no sign). Parts in
#: a thousand, and thousandths of a letter.
RESOLUTION = {"symbols": 5, "lines": 60, "repeats": 50, "length": 250}
BLANK = r"[\x20\x09-\x0D]+"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Up to so many different repeated windows are looked up in an array, more are found by sorting; the count is the same.
FEW = 48


def repeated_words(hashes: Column, twice: Column, pairs: Column) -> Column:
    """How many words stand in a three-word window found twice or more.

    `hashes` are those of the windows in order of place, `twice` the repeated ones among them, `pairs` the hashes with
    their places in order of hash, where there are more than FEW repeated ones.
    """
    places = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(twice, hashes[i]))
    return covered(F.when(F.size(twice) <= FEW, places).otherwise(sorted_places(pairs)))


def sorted_places(pairs: Column) -> Column:
    """The places, in order, of windows that have an equal neighbour in the sorted `pairs` of hash and place."""
    last = F.size(pairs) - 1
    met = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["i"].alias("i"), ((i > 0) & (F.get(pairs, i - 1)["h"] == p["h"]) | (i < last) & (F.get(pairs, i + 1)["h"] == p["h"])).alias("met"))),
        lambda p: F.coalesce(p["met"], F.lit(False)),
    )
    return F.sort_array(F.transform(met, lambda p: p["i"]))


def covered(places: Column) -> Column:
    """Words under three-word windows that start at the given places, in order."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def measured(docs: DataFrame, text: Column, out: str) -> DataFrame:
    """`docs` with a struct column `out` of COUNTS, of the whole text. A null text has no words."""
    t, w, h, s, d, p, li = (fresh(docs, f"{out}_{x}") for x in "twhsdpl")
    rows = docs.withColumn(t, F.coalesce(text, F.lit("")))
    rows = rows.withColumn(w, F.array_remove(F.split(F.col(t), BLANK), ""))
    rows = rows.withColumn(h, F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.col(w)[i], F.col(w)[i + 1], F.col(w)[i + 2]))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn(s, F.sort_array(h))
    rows = rows.withColumn(d, F.array_distinct(F.filter(F.col(s), lambda x, i: (i > 0) & (x == F.get(F.col(s), i - 1)))))
    paired = F.sort_array(F.transform(F.col(h), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn(p, F.when(F.size(d) > FEW, paired))
    rows = rows.withColumn(li, F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    repeats = F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(repeated_words(F.col(h), F.col(d), F.col(p)))
    counts = [
        F.size(w).cast("long"),
        F.length(F.regexp_replace(F.col(t), BLANK, "")).cast("long"),
        F.length(F.regexp_replace(F.col(t), r"[^#*$%&|<>]+", "")).cast("long"),
        F.size(li).cast("long"),
        (F.size(li) - F.size(F.array_distinct(li))).cast("long"),
        repeats,
    ]
    named = F.struct(*[c.alias(n) for c, n in zip(counts, COUNTS)])
    # a generated column: conditions on it are not worked out a second time below it
    return rows.select("*", F.explode(F.array(named)).alias(out)).drop(t, w, h, s, d, p, li)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])


def measures(c: Column) -> dict[str, Column]:
    """Whole numbers, so that any engine puts them in the same bucket."""
    share = lambda a, b: F.floor(F.lit(1000) * a / F.greatest(b, F.lit(1))).cast("long")
    return {
        "symbols": share(c["n_symbols"], c["word_chars"]),
        "lines": share(c["n_dup_lines"], c["n_lines"]),
        "repeats": share(c["n_repeat_words"], c["n_words"]),
        "length": share(c["word_chars"], c["n_words"]),
    }


def bucket(value: Column) -> Column:
    """The least value with the same six leading bits."""
    cut = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def group_key(column: str) -> Column:
    """A key that tells a null from any text, so that it joins like one."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))


def sketches(measured_docs: DataFrame, counts: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang_key, source_key, measure, bucket, n) over the documents that pass the fixed rules."""
    c = F.col(counts)
    passed = measured_docs.filter(~base_failed(c))
    each = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(v).alias("bucket")) for m, v in measures(c).items()])
    flat = passed.select(group_key(lang).alias("lang_key"), group_key(source).alias("source_key"), F.explode(each).alias("m"))
    return flat.groupBy("lang_key", "source_key", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, docs, q1, q2, q3) by each sketch; a window holds one sketch, which has a bounded size."""
    by = Window.partitionBy(*keys, "measure")
    run = sketch.withColumn("docs", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = [F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bucket"))).alias(f"q{k}") for k in (1, 2, 3)]
    return run.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), *at)


def thresholds(sketch: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """(lang_key, source_key, low, high): the bounds of each measure by name, for each group that has documents."""
    own = quartiles(sketch, ["lang_key", "source_key"])
    of_lang = quartiles(merged(sketch, ["lang_key"]), ["lang_key"])
    of_all = quartiles(merged(sketch, []), [])
    named = lambda df, tag: df.select(*[c for c in ("lang_key", "source_key", "measure") if c in df.columns], F.struct("docs", "q1", "q2", "q3").alias(tag))
    levels = named(own, "own").join(named(of_lang, "of_lang"), ["lang_key", "measure"]).join(named(of_all, "of_all"), ["measure"])
    used = F.when(F.col("own.docs") >= least, F.col("own")).when(F.col("of_lang.docs") >= least, F.col("of_lang")).otherwise(F.col("of_all"))
    chosen = levels.withColumn("q", used).withColumn("slack", F.create_map(*[F.lit(x) for kv in RESOLUTION.items() for x in kv])[F.col("measure")])
    bounds = chosen.select(
        "lang_key", "source_key", "measure",
        (F.col("q.q2") - reach * (F.col("q.q2") - F.col("q.q1") + F.col("slack"))).alias("low"),
        (F.col("q.q2") + reach * (F.col("q.q3") - F.col("q.q2") + F.col("slack"))).alias("high"),
    )
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("measure", c))).alias(c)  # noqa: E731  four of them
    return bounds.groupBy("lang_key", "source_key").agg(entries("low"), entries("high"))


def within(c: Column, low: Column, high: Column) -> Column:
    """Inside the group's bounds. Only the length of words has a lower one."""
    tests = [v <= high[m] for m, v in measures(c).items()] + [measures(c)["length"] >= low["length"]]
    held = tests[0]
    for t in tests[1:]:
        held = held & t
    return held


def judged(measured_docs: DataFrame, limits: DataFrame, counts: str, out: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows with `out`: they pass the fixed rules and lie within the bounds of their language and source."""
    lk, sk, lo, hi = (fresh(measured_docs, f"{counts}_{x}") for x in ("lang", "source", "low", "high"))
    keyed = measured_docs.withColumns({lk: group_key(lang), sk: group_key(source)})
    joined = lookup(keyed, limits.select(F.col("lang_key").alias(lk), F.col("source_key").alias(sk), F.col("low").alias(lo), F.col("high").alias(hi)), [lk, sk], "left")
    c = F.col(counts)
    verdict = ~base_failed(c) & F.coalesce(within(c, F.col(lo), F.col(hi)), F.lit(True))
    return joined.withColumn(out, verdict).drop(lk, sk, lo, hi)


def verdicts(docs: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    A null or empty text has no words and fails. Null languages and sources are groups of their own. Repeated rows
    count each. A table without rows gives none.
    """
    rows = measured(pick(docs, "doc_id", "text", "lang", "source"), F.col("text"), "counts")
    rows = stage(rows.select("doc_id", "lang", "source", "counts"), "measures")
    limits = stage(thresholds(sketches(rows, "counts"), least, reach), "thresholds")
    found = judged(rows, limits, "counts", "kept")
    return found.select("doc_id", *[F.col(f"counts.{n}").alias(n) for n in COUNTS if n != "n_lines"], base_failed(F.col("counts")).alias("base_failed"), "kept")


def keep(docs: DataFrame, least: int = LEAST, reach: int = REACH) -> DataFrame:
    """The rows that pass, as they are. Texts are read twice and never shuffled: for the sketches, then to be judged."""
    counts, kept = fresh(docs, "_counts"), fresh(docs, "_kept")
    first = measured(pick(docs, "text", "lang", "source"), F.col("text"), "counts")
    limits = stage(thresholds(sketches(first, "counts"), least, reach), "thresholds")
    again = measured(docs, F.col("text"), counts)
    return judged(again, limits, counts, kept).filter(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
