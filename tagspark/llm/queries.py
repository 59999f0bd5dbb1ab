"""The registered queries of this package, each over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import shared_dir
from . import bpe, collocations, decontaminate, langid, mixing, pages, pii, quality, simhash, token_counts, token_files, urls, whitening

#: The folder of vocabulary files; unset, it is asked of the package that holds them.
TOKENIZERS = "TAGSPARK_TOKENIZERS"


def vocabulary(name: str) -> str:
    folder = os.environ.get(TOKENIZERS)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), target, vocabulary("word_bpe_49k.json"))
    return token_files.read_digests(spark, target)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), pattern())


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), pattern())


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad): the label of the document that the url's path ends in; bad is of low quality or toxic."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/?#]*/[^?#]*?([0-9]{1,18})(?:\.html)?/?(?:[?#]|$)", 1).alias("number"))
    named = rows.select("page_id", F.expr("try_cast(nullif(number, '') as bigint)").alias("doc_id")).filter("doc_id is not null")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("long")).alias("bad"))
    return named.join(labels, "doc_id").select("page_id", "bad")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_token_files, op3_quality_rules, op4_language_id, op5_decontamination, op6_main_text, op7_token_counts, op8_byte_bpe,
        op9_url_filter, op10_simhash, op11_collocations, op12_source_mix, op13_whitening,
    )
}

#: Every count, cut and rank of op11 by SQL's own grouping, without shards or hashes.
OP11_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs
), words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (SELECT unnest(range(1, 5)) AS size
), starts AS (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size
), counted AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL
), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
), frequent AS (SELECT * FROM counted WHERE a >= 30
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE size > 1
), cuts AS (SELECT lang, size, phrase, w, a, unnest(range(1, size)) AS k FROM candidates
), parts AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a::HUGEINT + y.a) AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')
), lowest AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_starts AS (SELECT lang, w, a, size, k, unnest(range(1, size - k + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS k FROM candidates WHERE size > 2)
), longer AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS longer FROM inner_starts GROUP BY ALL
), own AS (
  SELECT c.* FROM lowest c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase
  WHERE g.longer IS NULL OR 100::HUGEINT * g.longer < 80::HUGEINT * c.a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {"op11_collocations": OP11_SQL}
