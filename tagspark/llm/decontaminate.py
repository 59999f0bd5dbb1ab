"""Benchmark decontamination: a broadcast hash set of the test items' n-grams against windows of the training words.

Words are runs of ASCII letters and digits and of any other non-ASCII character, with A-Z lowered. A window is 13
consecutive words of an item; an item of fewer words is one window. Only words that the items have get a number, so a
window can only start where that many numbered words follow each other; there a rolling hash is looked up in the sorted
hash set, and a found window is verified word by word.

Items are broadcast in blocks of at most `block_bytes` of text. One block is the usual case; more of them are scanned
one after the other and their hits meet per row, so a test set of any size is taken whole.
"""

from __future__ import annotations

import hashlib
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import pick, slices, whole_text

WINDOW = 13
BLOCK_BYTES = 32 << 20
#: A document is contaminated from one hit word in so many on.
SHARE = 20
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()  # a table: each byte as itself or blank
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """The words, A-Z lowered."""
    return text.translate(_WORDS).split()


class Windows:
    """The windows of a block of items: for each length their sorted hashes, and where in the items' words each stands."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        number = self.number.setdefault
        ids = [np.array([number(w, len(self.number) + 1) for w in words_of(text)], dtype=np.uint64) for _, text in items]
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        self.names = [name for name, _ in items]
        self.ids = np.concatenate([*ids, np.zeros(0, dtype=np.uint64)])
        self.item = np.repeat(np.arange(len(items)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.ids))  # words from here to the item's end
        own = np.minimum(np.repeat(sizes, sizes), window)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(own).tolist():
            starts = np.flatnonzero((own == size) & (left >= size))
            hashes = _hashes_at(self.ids, starts, size)
            order = np.argsort(hashes, kind="stable")
            self.known[size] = hashes[order], starts[order]

    def find(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Words of the text, which of them are hit, and the items that have a window in it. Each hit is verified word by word."""
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, repeat(0)), dtype=np.uint64, count=len(words))
        hit, found = np.zeros(len(words) + 1, dtype=np.int64), set()
        blank = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, (hashes, places) in self.known.items():
            if len(words) < size:
                continue
            starts = np.flatnonzero(blank[size:] == blank[: len(blank) - size])
            if not len(starts):
                continue
            rolled, turn = np.unique(_hashes_at(ids, starts, size), return_inverse=True)
            low, high = np.searchsorted(hashes, rolled, "left"), np.searchsorted(hashes, rolled, "right")
            for k in np.flatnonzero(high > low).tolist():
                place = places[low[k] : high[k]]
                for i in starts[turn == k].tolist():
                    same = np.ones(len(place), dtype=bool)
                    for j in range(size):
                        same &= self.ids[place + j] == ids[i + j]
                    if same.any():
                        found.update(self.names[x] for x in np.unique(self.item[place[same]]).tolist())
                        hit[i] += 1
                        hit[i + size] -= 1
        return len(words), np.cumsum(hit[:-1]) > 0, found


def _hashes_at(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(starts), dtype=np.uint64)
    for k in range(size):
        total = (total + ids[starts + k]) * _STEP
        total ^= total >> np.uint64(29)
    return total


def item_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int):
    """The items in blocks of bounded bytes, ready to be broadcast."""
    items = pick(benchmark, id_column, text_column).toDF("item", "text").filter("text is not null")
    items = items.select(F.col("item").cast("string").alias("item"), whole_text().alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        yield [(r["item"], bytes(r["text"])) for r in part.collect()]


_built: dict[tuple[str, int], Windows] = {}
#: Built blocks of items that a worker keeps.
KEPT_BLOCKS = 2


def _windows(name: str, cast, window: int) -> Windows:
    """A worker's own copy of a block's windows, built once while no more blocks than it may keep are in use."""
    if (name, window) not in _built:
        while len(_built) >= KEPT_BLOCKS:
            del _built[next(iter(_built))]
        _built[name, window] = Windows(cast.value, window)
    return _built[name, window]


def find_all(casts: list, texts: list[bytes], window: int) -> list[tuple[int, np.ndarray, set[str]]]:
    """For each text its words, which are hit, and the items met, over all blocks of items."""
    found: list = []
    for k, (name, cast) in enumerate(casts):
        here = [_windows(name, cast, window).find(t) for t in texts]
        found = here if not k else [(n, a | b, x | y) for (n, a, x), (_, b, y) in zip(found, here)]
    return found


def judge(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row of `docs`.

    Null and empty texts have no words and are clean. Items without words, null ones included, have no windows; null
    item ids take part under the empty name. A test set without rows leaves every document clean.
    """
    source = pick(docs, id_column, text_column).toDF("doc_id", "text").select("doc_id", whole_text().alias("text"))
    casts = _broadcasts(docs, benchmark, window, block_bytes)

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for n, hit, items in find_all(casts, batch.column("text").to_pylist(), window):
                n_hit = int(hit.sum())
                listed = sorted(items)
                rows.append((n, n_hit, len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), judge(n, n_hit), listed))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string())))]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=NAMES)

    doc_id = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {doc_id}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>")


NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]


def _broadcasts(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, id_column: str = "item_id", text_column: str = "text") -> list:
    context = docs.sparkSession.sparkContext
    return [(uuid.uuid4().hex, context.broadcast([(name or "", text) for name, text in block])) for block in item_blocks(benchmark, id_column, text_column, block_bytes)]


def clean(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_column: str = "text"
) -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) with the hit words of all documents cut out.

    Every column stays as it is, the text of a clean document too. A cut span goes from the first character of its
    first word to the last one of its last word. A null text is clean.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    casts = _broadcasts(docs, benchmark, window, block_bytes)
    at = docs.columns.index(text_column)

    def run(batches):
        for batch in slices(batches, f"_{at}"):
            texts = [None if t is None else t.encode() for t in batch.column(at).to_pylist()]
            found = find_all(casts, [t or b"" for t in texts], window)
            if remove == "documents":
                yield batch.filter(pa.array([not judge(n, int(hit.sum())) for n, hit, _ in found], pa.bool_()))
            else:
                cut = [t if t is None or not hit.any() else _cut(t, hit) for t, (_, hit, _) in zip(texts, found)]
                kind = batch.schema.field(at).type
                yield batch.set_column(at, batch.schema.field(at), pa.array([None if t is None else t.decode() for t in cut], kind))

    numbered = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])  # any name may stand in the columns
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def _cut(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between two hit neighbours."""
    plain = np.frombuffer(text.translate(_WORDS), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], plain.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    turns = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    for first, last in zip(turns[::2], turns[1::2]):
        kept.append(text[at : starts[first]])
        at = ends[last - 1]
    return b"".join([*kept, text[at:]])
