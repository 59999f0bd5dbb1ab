"""The operators over documents, beside brute force on whole tables and on odd rows."""

import base64
import os
from collections import Counter

import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tagspark.llm import bpe, decontaminate, langid, pii, quality, queries, simhash, token_counts, token_files

PATTERN = public_tokenizers.PATTERN
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ITEMS = [(1, "some-more words w3 4 some more words w4 5 some more words w5 6 some more"), (2, "one two"), (3, None), (None, ""), (4, "one two"), (10, "naïve'll"), (5, "never here at all")]


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


PII = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_base_spans(docs, odd, nothing):
    for df in (docs, odd):
        assert rows(pii.detected(df), *PII) == Counter((d, *plain.pii(t)) for d, t in texts(df))
    assert pii.detected(nothing).count() == 0


def test_base_spans_of_hard_texts(spark):
    hard = ["a@b.c_e@f.g", "@x.y a@b..c a@b.c. %@-.-", "1.2.3.4.5.6.7.8 1.2.3.256 0001.0.0.0", "+1+12 +123456789 0 (1)..2 +1 ((((", "4111 1111-1111 1111 x4111111111111111 4111  1111", "1" * 5000, "a" * 5000 + "@", "+" + "1 " * 500, "x" * 3000 + "@" + "a." * 3000 + "b"]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    assert rows(pii.detected(df), *PII) == Counter((i, *plain.pii(t)) for i, t in enumerate(hard))


def test_spans_keep_the_base_and_add_what_fixed_patterns_drop(spark):
    cards = ["4539148803436467", "4556737586899855", "6011000990139424", "5555555555554444"]
    lines = [(i, f"word {cards[i % 4]} more +1 (555) 012-{1000 + i} and a{i}@b.org, 10.0.0.{i} end") for i in range(200)]
    lines += [(500, f"pay {cards[0]} {cards[1]} now"), (501, "id 1234567890123456 and 999.999.999.999")]
    found = {r["doc_id"]: r for r in pii.detected(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    for d, t in lines:
        spans = found[d]["spans"].split(",") if found[d]["spans"] else []
        assert {f"{k}:{a}:{b}" for a, k, b in plain.base_spans(t)} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
    assert found[500]["n_card"] == 0 and found[500]["spans"] == "card:4:20,card:21:37"
    assert found[501]["spans"] == ""


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "é mail a@b.org, call +1 (555) 012-1000.", 3), (2, None, 4), (3, "clean", 5)], "doc_id long, text string, kept int")
    got = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert got[1]["text"] == "é mail [EMAIL], call [PHONE]." and got[2]["text"] is None and got[3]["text"] == "clean"
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == odd.count()


QUALITY = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(docs, odd, nothing):
    for df in (docs, odd):
        assert rows(quality.verdicts(df), *QUALITY) == Counter((d, *plain.quality(t)) for d, t in texts(df))
    assert quality.verdicts(nothing).count() == 0


def test_quality_thresholds_follow_their_group(spark):
    words = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst")
    rare, many = words + " ###### ######", words.replace(" ", " # ")
    rows_ = [(i, words, "en", "a", 0) for i in range(300)] + [(1000 + i, many, "en", "b", 0) for i in range(300)]
    rows_ += [(2000, many, "en", "a", 0), (2001, many, "en", "b", 0), (2002, rare, "en", "a", 0), (2003, words, None, None, 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not kept[2000] and kept[2001] and kept[1000] and kept[0] and kept[2003]
    assert sum(not k for k in kept.values()) <= 2


def test_quality_keeps_all_columns(odd, docs):
    assert quality.keep(odd).columns == odd.columns
    verdict = {r["doc_id"] for r in quality.verdicts(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in quality.keep(docs).collect()} == verdict


CONTAMINATION = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination(spark, docs, odd, nothing, items):
    whole = spark.read.parquet(f"{os.environ.get('TAGSPARK_TEST_SF', '/root/testdata/sf0.001')}/benchmark.parquet")
    for df, bench in ((docs, whole), (odd.filter("length(text) < 3000 or text is null"), items)):
        known = {r["item_id"]: r["text"] for r in bench.collect() if r["text"]}
        expected = Counter((d, *plain.contamination(t, known)) for d, t in texts(df))
        assert rows(decontaminate.contamination(df, bench), *CONTAMINATION) == expected
        if df is not docs:
            assert rows(decontaminate.contamination(df, bench, block_bytes=40), *CONTAMINATION) == expected
    assert decontaminate.contamination(nothing, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


def test_decontaminated_documents_and_spans(spark, odd, items):
    judged = {(r["doc_id"], r["n_words"]) for r in decontaminate.contamination(odd, items).collect() if r["contaminated"]}
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and left.count() < odd.count() and judged
    df = spark.createDataFrame([(1, "Start, one TWO; end"), (2, "nothing")], "doc_id long, text string")
    assert [r["text"] for r in decontaminate.clean(df, items, remove="spans").orderBy("doc_id").collect()] == ["Start, ; end", "nothing"]


def test_simhash_components(docs, odd, nothing):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {d: plain.fingerprint(t) for d, t in texts(docs)}
    roots = plain.components(prints)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()} == {d: (f"{p:016x}", roots[d]) for d, p in prints.items()}
    assert simhash.near_duplicates(odd).count() == odd.count()
    assert {r["component_id"] for r in simhash.near_duplicates(odd).filter("fingerprint = '0000000000000000'").collect()} == {0}
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(odd).columns == odd.columns


def test_links_of_crowded_signatures(spark):
    """Fingerprints around few centres: many share a signature, and the way for crowds finds the same components."""
    import random

    r = random.Random(3)
    prints = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(70):
            x = c
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    ids = dict(enumerate(sorted(prints)))
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in ids.items()}
    df = spark.createDataFrame([(p,) for p in signed.values()], "fp long")
    expected = plain.components(ids)
    for crowd in (2, 5, 1000):
        nodes = {r["node"]: r["root"] for r in simhash.components(simhash.signature_links(df, crowd)).collect()}
        groups: dict = {}
        for i, p in signed.items():
            groups.setdefault(nodes.get(p, ("alone", p)), set()).add(i)
        wanted: dict = {}
        for i, root in expected.items():
            wanted.setdefault(root, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 300)] + [(900, 901), (901, 900), (902, 902)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{200 + i: 200 for i in range(300)}, 900: 900, 901: 900}


def test_byte_bpe_equals_the_library(spark, docs, odd, nothing):
    import hashlib

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (docs, odd):
        expected = Counter()
        for d, t in texts(df):
            ids = library.encode_ordinary(t or "")
            expected[(d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), plain.sha(t or ""))] += 1
        assert rows(bpe.round_trips(df, MULTI, PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    coded = bpe.encoded(odd, MULTI, PATTERN)
    back = {(r["doc_id"], bytes(r["text"])) for r in bpe.decoded(coded, MULTI, PATTERN).collect()}
    assert back == {(d, (t or "").encode()) for d, t in texts(odd)}
    assert bpe.round_trips(nothing, MULTI, PATTERN).count() == 0


def test_appends_and_edits_re_encode_exactly():
    import random

    r, v = random.Random(5), bpe.encoder(MULTI, PATTERN).vocabulary
    for _ in range(400):
        text = bytes(r.choices(b"abcthein \n\xff\xc3\xa9", k=r.randint(2, 40)))
        i = r.randint(0, len(text))
        j, new = r.randint(i, len(text)), bytes(r.choices(b"abthe", k=r.randint(0, 4)))
        table = bpe.Prefixes(v, text[:i]).append(text[i:])
        kept = table.last[: i + 1]
        table.edit(i, j, new)
        assert table.last[: i + 1] == kept
        whole = text[:i] + new + text[j:]
        if whole not in v.ranks:
            assert table.tokens() == v.split(whole)


def test_token_counts_equal_the_library(docs, odd, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df in (docs, odd):
        expected = Counter()
        for d, t in texts(df):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            expected[(d, len((t or "").encode()), n, n > 1024)] += 1
        assert rows(token_counts.token_counts(df, path, PATTERN), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts.token_counts(nothing, path, PATTERN).count() == 0


def test_token_counts_by_pieces_equal_the_library_on_every_settled_character():
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = token_counts.counter(path, PATTERN)
    settled = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c < "\ue000" and token_counts.is_settled(c)]
    assert {"\u2019", "\u2014", "日", "я", "\U0001f600"} < set(settled) and len(settled) > 200_000
    lines = [f"a{c}b 1{c}2 {c}{c} '{c}\n{c} \t{c}.{c}'s" for c in settled]
    for at in range(0, len(lines), 20_000):
        some = lines[at : at + 20_000]
        assert [counter.by_pieces(t.encode()) for t in some] == [len(e.ids) for e in counter.library.encode_batch(some, add_special_tokens=False)]
    assert counter.by_pieces("<|endoftext|>".encode()) is None and counter.by_pieces("\u180e".encode()) is None


def test_token_files_round_trip(spark, docs, odd, nothing, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for k, df in enumerate((docs, odd)):
        target = f"{tmp_path}/{k}"
        token_files.write_tokens(df, target, path, partitions=5)
        start, expected = 0, []
        order = sorted(texts(df), key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
        for d, t in order:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
            expected.append((d, start, len(ids), plain.crc(ids)))
            start += len(ids)
        assert rows(token_files.read_digests(spark, target), "doc_id", "start", "n_tokens", "ids_crc32") == Counter(expected)
        assert rows(token_files.read_metadata(spark, target), "doc_id", "start", "n_tokens") == Counter(e[:3] for e in expected)
        some = [d for d, *_ in expected if d is not None][:3]
        assert {r["doc_id"] for r in token_files.read_tokens(spark, target, some).collect()} == set(some)
    token_files.write_tokens(nothing, f"{tmp_path}/none", path)
    assert token_files.read_digests(spark, f"{tmp_path}/none").count() == 0


def test_token_files_have_dictionary_and_page_index(docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_files.write_tokens(docs, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"))
    column = pq.ParquetFile(glob.glob(f"{tmp_path}/t/*.parquet")[0]).metadata.row_group(0).column(4)
    assert column.path_in_schema.startswith("ids") and any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index


def test_language_of_held_out_documents(spark, docs, odd, nothing):
    found = {r["doc_id"]: r for r in langid.languages_of(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    tested = [d for d, r in found.items() if r["held_out"]]
    assert sum(found[d]["lang_pred"] == truth[d] for d in tested) / len(tested) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.values())
    got = langid.languages_of(odd).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert langid.languages_of(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.languages_of(unlabelled).collect()} == {"und"}


def test_queries_give_the_contract_columns(spark):
    expected = {
        "op1_pii": list(PII) + ["spans"], "op2_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op3_quality_rules": [*QUALITY, "kept"],
        "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"], "op5_decontamination": list(CONTAMINATION), "op6_main_text": ["page_id", "url", "text", "n_chars"],
        "op7_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op8_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        "op9_url_filter": ["page_id", "host", "path", "rule", "verdict"], "op10_simhash": ["doc_id", "fingerprint", "component_id"],
    }
    assert set(expected) == set(queries.QUERIES)


def test_many_long_items_are_built_at_once_and_two_blocks_stay_built():
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 5000, 400)).encode()) for i in range(2000)]
    began = time.time()
    whole = decontaminate.Windows(items)
    assert time.time() - began < 20 and sum(len(h) for h, _ in whole.known.values()) == 2000 * 388
    text = b"other words " + b" ".join(items[7][1].split()[50:70]) + b" and more"
    n, hit, found = whole.find(text)
    assert (n, int(hit.sum()), found) == (24, 20, {"7"})

    class Cast:
        def __init__(self, value):
            self.value, self.reads = value, 0

        def __getattribute__(self, name):
            if name == "value":
                object.__setattr__(self, "reads", object.__getattribute__(self, "reads") + 1)
            return object.__getattribute__(self, name)

    casts = [("a", Cast(items[:1000])), ("b", Cast(items[1000:]))]
    for _ in range(5):
        assert decontaminate.find_all(casts, [text, b"", items[1500][1]], 13)[2][2] == {"1500"}
    assert [c.reads for _, c in casts] == [1, 1]
