"""The five stages on the smallest tables, each beside a plain version on its own input."""

import os

import plain
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tagspark.llm import bpe
from tagspark.sources.sinks import stage

SF = os.environ.get("TAGSPARK_TEST_SF", "/root/testdata/sf0.001")


def test_stages(spark):
    if not os.path.isdir(SF):
        pytest.skip("benchmark tables are not here")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF), name)
        if name != "byte_bpe":
            assert docs.columns == columns
        after = {r["doc_id"]: r["ids" if name == "byte_bpe" else "text"] for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "quality_rules":
            failed = {d for d, t in before.items() if plain.quality(t)[5]}
            assert failed <= gone and len(gone) < len(before) / 2
        elif name == "near_duplicates":
            prints = plain.components({d: plain.fingerprint(t) for d, t in before.items()})
            roots = plain.reached(prints, plain.similar(before))
            assert gone == {d for d, r in roots.items() if d != r} and gone > {d for d, r in prints.items() if d != r}
        elif name == "decontamination":
            assert gone == {d for d, t in before.items() if plain.contamination(t, items)[4]}
        elif name == "personal_data":
            assert not gone
            for d, t in before.items():
                spans = plain.base_spans(t)
                assert (after[d] == t) or "[" in after[d]
                assert not spans or after[d] != t
                assert not plain.base_spans(after[d])
        else:
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert after == {d: library.encode_ordinary(t) for d, t in before.items()}
        before = after


def test_run_over_odd_rows_and_no_rows(spark, odd, nothing, tmp_path):
    """Nulls, repeated rows and clashing columns pass all five stages, and so does a table without rows."""
    words = " ".join(f"{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klm")
    good = spark.createDataFrame([(900, words, None, "s", 1), (900, words, None, "s", 1), (None, words + " more", "en", None, None)], nothing.schema)
    items = spark.createDataFrame([(1, None), (None, "")], "item_id long, text string")
    for name, docs in (("odd", odd.unionByName(good, allowMissingColumns=True)), ("none", nothing)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
        if name == "none":
            assert not got
        else:
            assert [r["ids"] for r in got if r["doc_id"] == 900] == [library.encode_ordinary(words)]
            assert None not in [r["doc_id"] for r in got]
