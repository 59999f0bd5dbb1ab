"""Token ids as Parquet list columns: one row a document, in order of its id.

Ids are dictionary-encoded int32 lists (a page falls back to plain where the dictionary grows too large), row groups
hold `group_bytes` and pages at most `page_rows` documents. The document columns stand beside the list column, and the
column and offset indexes that the writer leaves give each page's range of document ids, so a read of some documents
opens only their pages, and a read of the counts never touches the ids.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import is_plain, quick_pattern
from .rows import Bounded, pick, slices, whole_text
from .token_counts import printable_bytes

END_ID = 2
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 1 << 20, 2000


class Words:
    """Ids by the tokenizers library. Where white space always ends a token, distinct words and pieces go to it once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        split = json.loads(self.library.to_str())["pre_tokenizer"]["pretokenizers"][0]
        self.quick, self.shown = quick_pattern(split["pattern"]["Regex"]), printable_bytes()
        self.pieces = Bounded(self._piece, limit=300_000)
        self.words = Bounded(self._word, limit=500_000)
        self.bytes = [int(i).to_bytes(4, "little") for i in range(self.library.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isalnum() else "".join(map(self.shown.__getitem__, piece.encode()))
        return b"".join([self.bytes[t.id] for t in self.library.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        parts = self.quick.findall(word)
        return self._piece(word) if len(parts) == 1 and parts[0] == word else b"".join(map(self.pieces.__getitem__, parts))

    def ids(self, data: bytes) -> bytes:
        """The ids as little-endian 32-bit numbers, by words where the text holds nothing unusual, else as a whole."""
        if not is_plain(data) or any(s in data for s in self.specials):
            return self.whole(data.decode())
        return b"".join(map(self.words.__getitem__, data.decode().lower().split()))


@lru_cache(maxsize=1)
def words(path: str) -> Words:
    """One for a worker. The path names a tokenizer whose pre-tokenizer drops white space and lowers letters."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Words(path)


def write_tokens(
    docs: DataFrame, target: str, path: str, end_id: int = END_ID, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS,
    id_column: str = "doc_id", text_column: str = "text", partitions: int | None = None,
) -> None:
    """Write (doc_id, part, before, n_tokens, ids) in ascending doc_id order to Parquet files under `target`.

    Ranges of ids are dealt to tasks, each sorts its own and writes it. `part` numbers the ranges in order, `before`
    is the number of ids of the range's earlier documents. Null ids come first; equal ids in order of their text.
    """
    source = pick(docs, id_column, text_column).toDF("doc_id", "text").select("doc_id", whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_first()]
    dealt = source.repartitionByRange(partitions, *order) if partitions else source.repartitionByRange(*order)
    sized = dealt.sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())

    def run(batches):
        code, before, end = words(path), 0, np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, "text", 4 << 20):
            found = [code.ids(t) for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4 + 1
            starts = before + np.concatenate(([0], np.cumsum(sizes)[:-1]))
            before = int(starts[-1] + sizes[-1])
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = np.frombuffer(end.join([*found, b""]), dtype="<i4")
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array(starts), pa.array(sizes), ids], names=["doc_id", "part", "before", "n_tokens", "ids"])

    kind = source.schema["doc_id"].dataType.simpleString()
    rows = sized.mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids array<int>")
    options = {
        "parquet.enable.dictionary": "true",
        "parquet.block.size": str(group_bytes),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(page_rows),
        "parquet.dictionary.page.size": str(1 << 20),
        "compression": "zstd",
    }
    rows.write.mode("overwrite").options(**options).parquet(target)


def read_metadata(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens) of every document in the files: `start` counts the ids of all documents before it.

    Only the count columns are read. The ranges' totals, one row for each written range, are summed in their order.
    """
    rows = spark.read.parquet(target).select("doc_id", "part", "before", "n_tokens")
    return _started(spark, rows, target).select("doc_id", "start", "n_tokens")


def _started(spark: SparkSession, rows: DataFrame, target: str) -> DataFrame:
    totals = spark.read.parquet(target).groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    earlier = F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each range that was written, whose number the partition setting bounds
    return rows.join(F.broadcast(totals.select("part", earlier.alias("_earlier"))), "part").withColumn("start", F.col("_earlier") + F.col("before"))


def read_tokens(spark: SparkSession, target: str, ids: list | None = None) -> DataFrame:
    """(doc_id, ids) of all documents, or of those with the given ids: the page index skips all other pages."""
    rows = spark.read.parquet(target).select("doc_id", "ids")
    return rows if ids is None else rows.filter(F.col("doc_id").isin(ids))


def read_digests(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the crc is over the ids as little-endian 32-bit numbers."""

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")  # the same bytes
            ends = lists.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "part", "before", "n_tokens")), pa.array(crcs, pa.int64())], names=["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(target).select("doc_id", "part", "before", "n_tokens", "ids")
    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = stored.mapInArrow(run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids_crc32 bigint")
    return _started(spark, rows, target).select("doc_id", "start", "n_tokens", "ids_crc32")
