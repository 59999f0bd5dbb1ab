"""Personal data by boosted trees over overlapping candidates, in DataFrame operations alone.

Fixed patterns give the base spans, which always stay. Wider patterns propose overlapping candidates as well: parts of
a run of digits that the fixed pattern takes as one and drops, masked mail addresses, numbers without a plus.
Each candidate has a few small whole-number features of its format and context. The documents with equal features form
a cell, so training needs only the cells' counts, whatever the size of the corpus: a candidate that is a base span is a
good one, one that fails its kind's check or cuts into a base span is a bad one, others are not trained on. Trees are
boosted on these counts, and each kind's threshold is the lowest score that is still as precise, among
labelled candidates of its score, as PRECISION asks. The trees become conditional expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .rows import fresh, pick

KINDS = ["email", "ip", "card", "phone"]
#: The fixed patterns, written so that no text makes them scan a run twice. Runs too short for a card or a phone are left out.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){9,}+",
}
#: The generators: more ways to write each kind, and shorter pieces of what the fixed patterns take whole.
WIDE = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[] ?at ?[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])[0-9]{13,19}(?![0-9])", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", r"(?<![0-9])3[0-9]{3}([\x20-])[0-9]{6}\1[0-9]{5}(?![0-9])"],
    "phone": [r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)[\x20]?|(?<![0-9])[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])", r"\+[0-9]{10,15}(?![0-9])"],
}
BYTE_VALUE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words near a number that name what it is.
CUES = r"(?i)mail|contact|phone|tel|call|fax|mobile|card|visa|credit|account|address|host|server|\bip\b"
FEATURES = ["digits", "marks", "valid", "before", "after", "cue", "plain", "shape"]
SPANS = f"array<struct<kind:int,start:int,end:int,base:boolean,{','.join(f'{f}:int' for f in FEATURES)}>>"
#: Hits of one text that are placed together.
BLOCK = 128
ROUNDS, RATE, DEPTH, PRECISION = 24, 0.4, 3, 0.9
CONTEXT = 16
#: Cells are bounded by the features' ranges; a fit over more of them than this would be a mistake in the features.
MOST_CELLS = 200_000


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Is the sum of the digits, every second one from the right doubled, a multiple of ten?"""
    d = F.reverse(digits_of(s))
    places = F.transform(F.split(d, "(?!^)(?!$)"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).cast("int"))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The kind's check of a span's text."""
    n = F.length(digits_of(s))
    if kind == "ip":
        return s.rlike(rf"^{BYTE_VALUE}(?:\.{BYTE_VALUE}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def beside(c: Column) -> Column:
    """What a span touches: nothing or a blank, a mark, a letter or digit."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}\p{N}]"), 2).otherwise(1)


def features(kind: str, s: Column, before: Column, after: Column) -> list[Column]:
    digits = digits_of(s)
    shapes = {
        "email": F.when(s.contains("@"), F.when(s.rlike(r"\.[A-Za-z]{2,}$"), 2).otherwise(1)).otherwise(0),
        "ip": F.when(s.rlike(r"^[1-9]"), 1).otherwise(0),
        "card": F.when(s.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[ -][0-9]{4}){3})$"), F.when(s.rlike("^[3-6]"), 2).otherwise(1)).otherwise(0),
        "phone": F.when(s.startswith("+"), F.when(s.contains("("), 3).otherwise(2)).when(s.contains("("), 1).otherwise(0),
    }
    return [
        F.least(F.length(digits), F.lit(20)),
        F.least(F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")), F.lit(7)),
        F.coalesce(valid(kind, s), F.lit(False)).cast("int"),
        beside(F.right(before, F.lit(1))),
        beside(F.left(after, F.lit(1))),
        before.rlike(CUES).cast("int"),
        digits.rlike(r"^(.)\1*$").cast("int"),
        shapes[kind],
    ]


def spans_of(zipped: Column, kind: str, base: bool) -> Column:
    """Candidates from (gap, hit, next gap): places are the running sum of what stands before, in code points.

    The sum runs in blocks, so that no array grows element by element over all hits of a text.
    """
    def one(pos, x):
        start = pos + F.length(x["gap"])
        f = features(kind, x["hit"], F.right(x["gap"], F.lit(CONTEXT)), F.left(F.coalesce(x["next"], F.lit("")), F.lit(CONTEXT)))
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), start.cast("int").alias("start"), (start + F.length(x["hit"])).cast("int").alias("end"),
            F.lit(base).alias("base"), *[v.cast("int").alias(n) for n, v in zip(FEATURES, f)],
        )

    step = lambda a, x: F.struct((a["pos"] + F.length(x["gap"]) + F.length(x["hit"])).alias("pos"), F.concat(a["out"], F.array(one(a["pos"], x))).alias("out"))
    start = lambda pos: F.struct(pos.alias("pos"), F.array().cast(SPANS).alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int")), lambda i: F.slice(zipped, i * BLOCK + 1, BLOCK))
    runs = F.aggregate(
        blocks,
        F.array().cast(f"array<struct<pos:int,out:{SPANS}>>"),
        lambda a, block: F.concat(a, F.array(F.aggregate(block, start(F.coalesce(F.get(a, F.size(a) - 1)["pos"], F.lit(0))), step))),
    )
    return F.flatten(F.transform(runs, lambda r: r["out"]))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def same(a: Column, b: Column) -> Column:
    return (a["kind"] == b["kind"]) & (a["start"] == b["start"]) & (a["end"] == b["end"])


def proposed(docs: DataFrame, text: Column, base: str, candidates: str) -> DataFrame:
    """`docs` with `base` (the spans of the fixed patterns) and `candidates` (those and the proposed ones, with
    features and `label`: 1, 0 or null). A null text is empty."""
    t = fresh(docs, "_text")
    rows = docs.withColumn(t, F.coalesce(text, F.lit("")))
    patterns = [(k, p, p == BASE[k]) for k in KINDS for p in (BASE[k], *WIDE[k])]
    gaps, hits = {}, {}
    for i, (_, p, _) in enumerate(patterns):
        gaps[i], hits[i] = fresh(docs, f"_gaps{i}"), fresh(docs, f"_hits{i}")
    some = F.col(t).rlike(r"[0-9@]|[(\[] ?at ?[)\]]")
    rows = rows.withColumns({hits[i]: F.when(some, F.regexp_extract_all(F.col(t), F.lit(p), F.lit(0))) for i, (_, p, _) in enumerate(patterns)})
    rows = rows.withColumns({gaps[i]: F.when(F.size(hits[i]) > 0, F.split(F.col(t), p, -1)) for i, (_, p, _) in enumerate(patterns)})
    found = {i: fresh(docs, f"_found{i}") for i in gaps}
    for i in gaps:
        pairs = F.zip_with(F.slice(F.col(gaps[i]), 1, F.size(hits[i])), F.col(hits[i]), lambda a, b: F.struct(a.alias("gap"), b.alias("hit")))
        zipped = F.zip_with(pairs, F.slice(F.col(gaps[i]), 2, F.size(hits[i])), lambda x, n: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), n.alias("next")))
        rows = rows.withColumn(found[i], F.when(F.size(hits[i]) > 0, zipped))
    rows = rows.drop(*gaps.values(), *hits.values(), t)
    out = [F.when(F.col(found[i]).isNotNull(), spans_of(F.col(found[i]), kind, is_base)).otherwise(F.array().cast(SPANS)) for i, (kind, _, is_base) in enumerate(patterns)]
    every, parts = fresh(docs, "_spans"), fresh(docs, "_parts")
    rows = rows.withColumn(parts, F.array(*out)).drop(*found.values())
    rows = rows.withColumn(every, F.flatten(parts)).drop(parts)
    rows = rows.withColumn(base, F.filter(every, lambda c: c["base"] & (c["valid"] == 1)))

    def labelled(c):
        b = F.col(base)
        good = F.exists(b, lambda x: same(x, c))
        bad = (c["valid"] == 0) | F.exists(b, lambda x: overlaps(x, c))
        return F.struct(*[c[n].alias(n) for n in ("kind", "start", "end", *FEATURES)], F.when(good, 1).when(bad, 0).alias("label"))

    return rows.withColumn(candidates, F.transform(every, labelled)).drop(every)


class Trees:
    """Boosted trees of one kind, and the score from which a candidate is taken; None takes none."""

    def __init__(self, bias: float, trees: list, threshold: float | None):
        self.bias, self.trees, self.threshold = bias, trees, threshold

    def score(self, f: dict) -> float:
        return self.bias + sum(_leaf(t, f) for t in self.trees)

    def column(self, c: Column) -> Column:
        total = F.lit(self.bias)
        for t in self.trees:
            total = total + _column(t, c)
        return total


def _leaf(tree, f: dict) -> float:
    while isinstance(tree, tuple):
        name, at, low, high = tree
        tree = low if f[name] <= at else high
    return tree


def _column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    name, at, low, high = tree
    return F.when(c[name] <= at, _column(low, c)).otherwise(_column(high, c))


def _grow(cells: list, depth: int):
    """A tree on (features, gradient, hessian) cells by the gain of each split; leaves are damped Newton steps."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (1e-9, None, None)
    if depth:
        for name in FEATURES:
            sums: dict[int, list[float]] = {}
            for f, a, b in cells:
                s = sums.setdefault(f[name], [0.0, 0.0])
                s[0] += a
                s[1] += b
            left_g = left_h = 0.0
            for value in sorted(sums)[:-1]:
                left_g, left_h = left_g + sums[value][0], left_h + sums[value][1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                best = max(best, (gain, name, value), key=lambda x: x[0])
    if best[1] is None:
        return RATE * g / (h + 1)
    _, name, at = best
    return (name, at, _grow([c for c in cells if c[0][name] <= at], depth - 1), _grow([c for c in cells if c[0][name] > at], depth - 1))


def boost(cells: list[tuple[dict, int, int]], precision: float = PRECISION) -> Trees:
    """Trees for (features, good, bad) cells by logistic loss, and the calibrated threshold."""
    good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not good:
        return Trees(0.0, [], None)
    bias = math.log((good + 1) / (bad + 1))
    scores, trees = [bias] * len(cells), []
    for _ in range(ROUNDS):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        graded = [(f, p - (p + q) * c, (p + q) * c * (1 - c)) for (f, p, q), c in zip(cells, chance)]
        trees.append(_grow(graded, DEPTH))
        scores = [s + _leaf(trees[-1], f) for s, (f, _, _) in zip(scores, cells)]
    # pools of falling score whose share of good ones falls too: a score's share is its pool's
    pools: list[list] = []
    for score, (_, a, b) in sorted(zip(scores, cells), key=lambda x: -x[0]):
        pools.append([score, a, b])
        while len(pools) > 1 and (pools[-1][0] == pools[-2][0] or pools[-1][1] * (pools[-2][1] + pools[-2][2]) >= pools[-2][1] * (pools[-1][1] + pools[-1][2])):
            low, a, b = pools.pop()
            pools[-1] = [low, pools[-1][1] + a, pools[-1][2] + b]
    precise = [score for score, a, b in pools if a >= precision * (a + b)]
    threshold = min(precise) if precise else None
    return Trees(bias, trees, threshold)


def fit(candidates: DataFrame, column: str) -> list[Trees]:
    """One set of trees a kind, from the counts of all labelled candidates by cell."""
    flat = candidates.select(F.explode(column).alias("c")).filter("c.label is not null")
    counted = flat.groupBy("c.kind", *[f"c.{f}" for f in FEATURES]).agg(F.sum("c.label").alias("good"), F.sum(1 - F.col("c.label")).alias("bad"))
    rows = counted.orderBy("kind", *FEATURES).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells of features")
    cells = [[({f: r[f] for f in FEATURES}, r["good"], r["bad"]) for r in rows if r["kind"] == k] for k in range(len(KINDS))]
    return [boost(c) for c in cells]


def chosen(base: Column, candidates: Column, trees: list[Trees]) -> Column:
    """Base spans and the candidates that pass their kind's threshold, in order of start and kind.

    A candidate that overlaps a base span adds nothing and goes; of overlapping others the best stays: by score, then
    length, then place, then kind.
    """
    def by_kind(c, value, otherwise):
        found = F.lit(otherwise)
        for k, t in enumerate(trees):
            if t.threshold is not None:
                found = F.when(c["kind"] == k, value(t)).otherwise(found)
        return found

    scored = F.transform(candidates, lambda c: F.struct(
        (-by_kind(c, lambda t: t.column(c) - F.lit(t.threshold), -1.0)).alias("rank"), (c["start"] - c["end"]).alias("size"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    able = F.array_sort(F.filter(scored, lambda c: (c["rank"] <= 1e-9) & ~F.exists(base, lambda b: overlaps(b, c))))
    kind = "array<struct<start:int,kind:int,end:int>>"
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    added = F.aggregate(able, F.array().cast(kind), lambda a, c: F.when(F.exists(a, lambda b: overlaps(b, c)), a).otherwise(F.concat(a, F.array(plain(c)))))
    return F.array_sort(F.concat(F.transform(base, plain), added))


def listed(spans: Column) -> Column:
    """`kind:start:end`, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row. A null text is empty.

    Texts are read once: their candidates are written, the trees are fitted on them and choose among them.
    """
    rows = proposed(pick(docs, "doc_id", "text"), F.col("text"), "base", "candidates").select("doc_id", "base", "candidates")
    rows = stage(rows, "candidates")
    trees = fit(rows, "candidates")
    plain = F.array_sort(F.transform("base", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    counts = [F.size(F.filter("base", lambda c: c["kind"] == KINDS.index(name))).cast("long").alias(f"n_{name}") for name in KINDS]
    return rows.select("doc_id", *counts, F.sha2(listed(plain), 256).alias("base_sha256"), listed(chosen(F.col("base"), F.col("candidates"), trees)).alias("spans"))


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with each found span of the text as `[EMAIL]`, `[IP]`, `[CARD]` or `[PHONE]`; a null text stays null.

    Overlapping spans are replaced as one, by the kind of the first. Texts are read twice and never shuffled.
    """
    text = F.col(f"`{text_column}`")
    base, candidates, found, runs = (fresh(docs, n) for n in ("_base", "_candidates", "_found", "_runs"))
    first = proposed(docs.select(text.alias("text")), F.col("text"), "base", "candidates")
    trees = fit(stage(first.select("candidates"), "candidates"), "candidates")
    rows = proposed(docs, text, base, candidates).withColumn(found, chosen(F.col(base), F.col(candidates), trees)).drop(base, candidates)
    kind = "array<struct<start:int,kind:int,end:int,from:int>>"
    joined = F.aggregate(
        found,
        F.array().cast(kind),
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.element_at(a, -1)["kind"].alias("kind"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"), F.element_at(a, -1)["from"].alias("from")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.when(F.size(a) > 0, F.element_at(a, -1)["end"]).otherwise(0).alias("from"))))),
    )
    rows = rows.withColumn(runs, F.when(F.size(found) > 0, joined)).drop(found)
    masks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    pieces = F.transform(runs, lambda s: F.concat(F.substring(text, s["from"] + 1, s["start"] - s["from"]), masks[s["kind"]]))
    tail = F.substring(text, F.element_at(runs, -1)["end"] + 1, F.length(text))
    masked = F.when(F.size(runs) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
    return rows.withColumn(text_column, masked).select(*[F.col(f"`{c}`") for c in docs.columns])
