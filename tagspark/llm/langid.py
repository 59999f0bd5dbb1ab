"""Language by nearest centroid: TF-IDF vectors of byte n-grams against several clustered centroids a language.

A text's vector counts its hashed n-grams of one to four bytes over lowered letters, damped by a root, weighted by how
few training documents hold each, and normalised. Document frequencies are summed over all training
documents in Spark. Centroids are spherical k-means clusters of a bounded sample of labelled rows (SAMPLE in all, dealt
evenly to the languages by a hash). A text goes to the language of the centroid with the largest cosine;
beyond the distance that nearly all sampled documents of that centroid keep, it is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stage
from .rows import pick, slices, whole_text

DIMENSIONS = 4096
#: Labelled rows that centroids are fitted on, over all languages, and clusters of a language at most.
SAMPLE, CLUSTERS, ROUNDS = 4000, 4, 12
#: A text further than this share of a centroid's own sample is rejected.
REJECT = 0.005
#: Hashing works through a text in pieces of so many bytes that overlap by three.
PIECE = 1 << 20
UNKNOWN = "und"
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def grams(text: bytes) -> np.ndarray:
    """Counts of the hashed n-grams of a text."""
    # runs of anything but letters become one blank; lowering is Unicode's
    data = b" " + b" ".join(text.decode().lower().encode().translate(_LETTERS).split()) + b" "
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for start in range(0, len(data), PIECE):
        part = np.frombuffer(data[max(0, start - 3) : start + PIECE], dtype=np.uint8).astype(np.uint32)
        fresh = min(3, start)  # bytes that the piece before has ended grams on
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, 5):
            if len(part) < n:
                break
            code = (part if n == 1 else code[:-1] * np.uint32(257) + part[n - 1 :]).astype(np.uint32)
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            counts += np.bincount((mixed >> np.uint32(20))[max(0, fresh - n + 1) :], minlength=DIMENSIONS)
    return counts


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.sqrt(counts, dtype=np.float32) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Languages, centroids with the language of each, their largest kept distances, and the weights of the n-grams."""

    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray
    idf: np.ndarray

    def predict(self, counts: np.ndarray) -> list[tuple[str, float, bool]]:
        """(language, cosine of 0 to 1, rejected) of each row of counts."""
        cosine = vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        return [(self.languages[self.owner[b]], float(t), bool(1 - t > self.radius[b])) for b, t in zip(best, top)]


def clusters(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, each further seed the row that is furthest from the seeds so far. (centroids, owner)"""
    seeds = [int((rows @ rows.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(rows)):
        seeds.append(int((rows @ rows[seeds].T).max(axis=1).argmin()))
    centre = rows[seeds].copy()
    owner = np.zeros(len(rows), dtype=np.int64)
    for _ in range(rounds):
        owner = (rows @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, owner, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.maximum(size, 1e-12), centre)
    return centre, owner


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed n-gram occurs, and of how many: one vector from each task, summed by Spark."""

    def run(batches):
        held, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                held += grams(text) > 0
                n += 1
        yield pa.record_batch([pa.array([held.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], names=["held", "n"])

    sums = training.mapInArrow(run, "held array<bigint>, n bigint").select("n", F.posexplode("held").alias("gram", "held"))
    rows = sums.groupBy("gram").agg(F.sum("held").alias("held"), F.sum("n").alias("n")).collect()  # DIMENSIONS rows
    held = np.zeros(DIMENSIONS)
    for r in rows:
        held[r["gram"]] = r["held"]
    return held, max((r["n"] for r in rows), default=0)


def sampled(training: DataFrame, sample: int) -> DataFrame:
    """At most `sample` rows, as many of each language, by a hash. Texts move only for the rows that pass the hash."""
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().orderBy("lang").limit(sample).collect()}
    if not sizes:
        return training.limit(0)
    each, scale = max(1, sample // len(sizes)), 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(scale, scale * (each + 30) * 2 // n))])
    mark = F.xxhash64("mark", "text")
    some = training.withColumn("mark", mark).filter(F.pmod("mark", F.lit(scale)) < F.coalesce(share[F.col("lang")], F.lit(0)))
    return some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("mark"))).filter(F.col("r") <= each).select("lang", "text")


def fit(training: DataFrame, sample: int = SAMPLE, k: int = CLUSTERS) -> Model | None:
    """`training` has mark (any value to hash by), lang and text (binary), without null texts. None where it has no row."""
    held, n = document_frequencies(training.select("text"))
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + held)) + 0.1).astype(np.float32)

    def run(batches):
        for batch in slices(batches, "text"):
            counts = [grams(t) for t in batch.column("text").to_pylist()]
            packed = pa.array([c.astype("<f4").tobytes() for c in counts], pa.binary())
            yield pa.record_batch([batch.column("lang"), packed], names=["lang", "counts"])

    rows = stage(sampled(training, sample).mapInArrow(run, "lang string, counts binary"), "sample")
    by_lang: dict[str, list] = {}
    for r in rows.orderBy("lang", "counts").toLocalIterator():
        by_lang.setdefault(r["lang"], []).append(np.frombuffer(r["counts"], dtype="<f4"))
    centroids, owner, radius = [], [], []
    languages = sorted(by_lang)
    for i, lang in enumerate(languages):
        unit = vectors(np.array(by_lang[lang]), idf)
        centre, member = clusters(unit, k)
        for c in range(len(centre)):
            near = 1 - unit[member == c] @ centre[c]
            if len(near):
                centroids.append(centre[c])
                owner.append(i)
                radius.append(float(np.quantile(near, 1 - REJECT)) * 1.25)
    return Model(languages, np.array(centroids, dtype=np.float32), np.array(owner), np.array(radius), idf)


def predicted(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row: score is the largest cosine.

    `und`, 0 and rejected where the text is null or has no letter, or nothing was learned.
    """
    source = pick(docs, id_column, text_column).toDF("doc_id", "text")
    cast = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS vectors of each sampled language

    def run(batches):
        known = cast.value
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            found = [(UNKNOWN, 0.0, True)] * len(texts)
            usable = [i for i, t in enumerate(texts) if known is not None and t is not None and has_letter(t)]
            for start in range(0, len(usable), 512):
                some = usable[start : start + 512]
                for i, f in zip(some, known.predict(np.array([grams(texts[i]) for i in some]))):
                    found[i] = f
            lang, score, rejected = zip(*found)
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(doc_id):
    """A fifth of the documents, by id, that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def languages_of(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row; learned from labelled rows that are not held out.

    Null ids count as not held out. Rows that have a null text or language are not learned from.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    training = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fit(training.select(F.col("doc_id").alias("mark"), "lang", whole_text().alias("text")), sample)
    found = predicted(rows, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
