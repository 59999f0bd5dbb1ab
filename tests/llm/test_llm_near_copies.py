"""Near copies beside brute force over all pairs of texts."""

import random

from plain import similar

from tagspark.llm import near_copies, simhash


def test_near_copies_of_a_table(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"] for r in simhash.one_of_each(docs, links=near_copies.links(docs)).collect()}
    roots = similar(texts)
    plain = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert left == {d for d in texts if roots[d] == d and plain[d] == d}
    assert left < {d for d in texts if plain[d] == d}


def test_crowds_of_near_copies(spark):
    """Two crowds around texts of half their words in common, single texts, and texts without or with few words."""
    r = random.Random(7)
    base = [f"w{r.randrange(10**6)}" for _ in range(300)]
    other = base[:150] + [f"v{r.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for words in (base, other):
        for _ in range(60):
            changed = list(words)
            for i in r.sample(range(300), r.choice((0, 1, 3, 6, 12))):
                changed[i] = f"x{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(changed)
    texts |= {200: " ".join(reversed(base)), 201: None, 202: "", 203: "one Two", 204: "one two", 205: "one two three"}
    df = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    roots = similar({d: t for d, t in texts.items() if t})
    for crowd in (3, 1000):
        found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, links=near_copies.links(df, crowd=crowd)).collect()}
        plain = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df).collect()}
        assert found[201] == found[202] == 201
        assert all(found[d] == found[root] for d, root in roots.items())
        assert all(found[d] == found[root] for d, root in plain.items())
        assert found[0] != found[60] and found[200] == 200 and found[205] == 205
    assert near_copies.links(df.limit(0)).count() == 0


def test_one_row_of_each_component(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four five", "sun moon sky sea land")
    rows = [(5, a, 1.0), (7, a.upper(), 2.0), (5, b, 3.0), (1, b.upper(), 4.0), (9, c, 5.0), (9, c, 6.0), (None, c, 7.0), (None, "none else", 8.0), (None, "none else", 9.0), (None, None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` double")
    left = simhash.one_of_each(df)
    assert left.columns == df.columns
    left = {(r["doc_id"], r["text"]): r["a.b"] for r in left.collect()}
    assert left.keys() == {(5, a), (1, b.upper()), (9, c), (None, "none else"), (None, None)}
    assert left[9, c] in (5.0, 6.0) and simhash.one_of_each(df).count() == 5


def test_a_crowd_of_texts_too_far_apart_is_not_paired(spark, monkeypatch):
    """Copies that each changed more than a link allows, and copies of some of them that did not."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = {}
    for _ in range(90):
        changed = list(base)
        for i in r.sample(range(300), r.choice((7, 9, 14))):
            changed[i] = f"x{r.randrange(10**9)}"
        texts[len(texts)] = " ".join(changed)
    for d in range(0, 30, 3):
        texts[len(texts)] = texts[d].replace(f"w{d + 20}", f"y{d}")
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    paired, stage = [], near_copies.stage

    def counted(rows, name):
        made = stage(rows, name)
        if name == "pairs":
            paired.append(made.count())
        return made

    monkeypatch.setattr(near_copies, "stage", counted)
    found = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, links=near_copies.links(df)).collect()}
    roots = similar(texts)
    assert all(found[d] == found[root] for d, root in roots.items())
    assert all(found[90 + k] == found[3 * k] for k in range(10))
    assert sum(paired) < 10 * len(texts)
