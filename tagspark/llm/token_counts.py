"""Token counts with a whole-token shortcut.

Before any text is read, each string of the vocabulary is tried: those that the pre-tokenizer leaves whole and that
merging turns into one token are proven, and a pre-token among them counts one. Only other pre-tokens are merged, by the
library's own model. Only texts that hold special strings, or characters that newer versions of Unicode added or moved to
another kind (so that libraries may differ on them), are counted by the library as a whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Known, chunks_of, is_plain, quick_pattern
from .rows import Bounded, pick, slices, whole_text

LIMIT = 1024


def printable_bytes() -> dict[int, str]:
    """Byte-level vocabularies write each byte as one visible character: itself, or the next free one from U+0100."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


def kind(character: str, database) -> str:
    """What a pre-tokenizer tells apart: letter, number, white space or other."""
    category = database.category(character)
    if category[0] == "Z" or "\t" <= character <= "\r" or character == "\x85":
        return "Z"
    return category[0] if category[0] in "LN" else "other"


def is_settled(character: str) -> bool:
    """Has the character been of one kind since Unicode 3.2? Libraries agree on such characters, whatever their version."""
    if character == "\u180e":  # a space from Unicode 4.0 to 6.2 alone, a format character before and after
        return False
    return unicodedata.category(character) != "Cn" and kind(character, unicodedata) == kind(character, unicodedata.ucd_3_2_0)


class Counter:
    """Counts tokens as the library's tokenizer at `path` gives them."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.shown = printable_bytes()
        self.pattern, self.quick = regex.compile(pattern), quick_pattern(pattern)
        self.settled = Known(is_settled)
        self.whole = self.prove()
        self.merged = Bounded(self._merge, limit=400_000)
        self.counts = Bounded(self._count, limit=600_000)

    def prove(self) -> frozenset[str]:
        """The strings of the vocabulary that are one pre-token and encode alone as one token."""
        back = {c: b for b, c in self.shown.items()}
        proven = []
        for shown in self.library.get_vocab(with_added_tokens=False):
            try:
                text = bytes(back[c] for c in shown).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.is_settled(text) and self.pattern.fullmatch(text) and len(self.library.model.tokenize(shown)) == 1:
                proven.append(text)
        return frozenset(proven)

    def is_settled(self, text: str) -> bool:
        return all(map(self.settled.__getitem__, set(text)))

    def _merge(self, piece: str) -> int:
        return len(self.library.model.tokenize("".join(map(self.shown.__getitem__, piece.encode()))))

    def _sum(self, pieces: list[str]) -> int:
        return sum(1 if p in self.whole else self.merged[p] for p in pieces)

    def _count(self, chunk: str) -> int:
        return self._sum(self.quick.findall(chunk))

    def by_pieces(self, data: bytes) -> int | None:
        """The count by pre-tokens; None for a text with a special string or an unsettled character."""
        if any(s in data for s in self.specials):
            return None
        text = data.decode()
        if self.quick is not None and is_plain(data):
            return sum(map(self.counts.__getitem__, chunks_of(text)))
        return self._sum(self.pattern.findall(text)) if self.is_settled(text) else None

    def count(self, data: bytes) -> int:
        n = self.by_pieces(data)
        return len(self.library.encode(data.decode(), add_special_tokens=False).ids) if n is None else n


@lru_cache(maxsize=1)
def counter(path: str, pattern: str) -> Counter:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. A null or empty text has no bytes and no tokens."""
    source = pick(docs, id_column, text_column).toDF("doc_id", "text").select("doc_id", whole_text().alias("text"))

    def run(batches):
        counts = counter(path, pattern)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            n = [counts.count(t) for t in texts]
            columns = [pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
