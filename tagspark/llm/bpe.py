"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of a piece is decided by the last token of each of its prefixes: a token that ends a prefix is its last
one exactly when it starts the prefix or merging keeps it apart from the last token of what stands before it. Exactly
one token passes for each prefix. The table of last tokens therefore grows with every appended byte without looking
back, an edit only redoes the prefixes from the edited byte on, and the encoding is read off from the end.

Ranks order the merges: the pair of neighbours whose joined bytes have the lowest rank is merged first, the leftmost of
equal ones. A piece that is a token as a whole is that token.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Bounded, pick, slices, whole_text

#: The letters, numbers and white space below U+0240, where any Unicode version agrees on them.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ȿ"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t-\r \x85\xa0"
#: UTF-8 bytes of texts that hold only characters below U+0240 and no odd control characters.
PLAIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xC9)])
#: Last tokens of prefixes of up to so many bytes are kept for other pieces, and so many of them.
ENDS_LENGTH, ENDS_KEPT = 16, 1 << 19
_CHUNK = re.compile(rf"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


@lru_cache(maxsize=None)
def quick_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with plain character classes, for texts of PLAIN_BYTES; None where it uses anything else."""
    plain = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
    plain = plain.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")
    plain = plain.replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")
    return None if r"\p" in plain else re.compile(plain)


def is_plain(data: bytes) -> bool:
    return not data.translate(None, PLAIN_BYTES)


def chunks_of(text: str) -> list[str]:
    """White space with the word that follows it. No match of the pattern reaches over the end of a chunk."""
    return _CHUNK.findall(text)


class Known(dict):
    """What `make` returns for a key, for ever: of tokens, whose number is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


class Vocabulary:
    """Ranks of byte strings, and which tokens stay apart side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.apart: Bounded = Bounded(lambda pair: self._stay_apart(*pair), limit=1 << 19)
        self.ends: dict[bytes, int] = {}  # last tokens of short prefixes, which many pieces share
        self.whole = Known(self._whole)

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merging joins last to form this one; None for a byte and where merging forms another."""
        if token not in self.parts:
            text = self.bytes[token]
            self.parts[token] = None
            if len(text) > 1:
                left = self.split(text, token)
                self.parts[token] = (left[0], left[1]) if len(left) == 2 else None
        return self.parts[token]

    def split(self, text: bytes, below: int | None = None) -> list[int]:
        """Merging by rank, of ranks under `below` alone: the definition, for token strings and for tests."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60 or below is not None and rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _whole(self, token: int) -> bool:
        """Does merging the token's bytes give the token?"""
        return len(self.bytes[token]) == 1 or self.last_merge(token) is not None

    def _stay_apart(self, left: int, right: int) -> bool:
        """Does no merge join bytes of both? Both are taken back merge by merge, the later merge first: what then
        touches at the border was there before that merge, and joins if its own rank comes earlier."""
        before = 1 << 60
        while True:
            joined = self.ranks.get(self.bytes[left] + self.bytes[right])
            if joined is not None and joined < before:
                return False
            a, b = self.last_merge(left), self.last_merge(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]


class Prefixes:
    """The last token of each prefix of a piece. `append` adds bytes; `edit` replaces some and redoes the rest."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [None]
        self.append(piece)

    def append(self, more: bytes) -> "Prefixes":
        v = self.vocabulary
        token_of, apart, whole, last, ends = v.ranks.get, v.apart, v.whole, self.last, v.ends
        start, longest = len(self.piece), v.longest
        piece = self.piece = self.piece + more
        if len(ends) >= ENDS_KEPT:
            ends.clear()
        for end in range(start + 1, len(piece) + 1):
            prefix = piece[:end] if end <= ENDS_LENGTH else None
            token = ends.get(prefix)
            if token is None:
                token = token_of(piece[:end]) if end <= longest else None
                if token is None or not whole[token]:
                    for begin in range(max(1, end - longest), end):
                        token = token_of(piece[begin:end])
                        if token is not None and apart[last[begin], token] and whole[token]:
                            break
                if prefix is not None:
                    ends[prefix] = token
            last.append(token)
        return self

    def edit(self, start: int, end: int, new: bytes) -> "Prefixes":
        """`new` in place of the bytes from `start` to `end`; prefixes up to `start` are kept as they are."""
        rest = new + self.piece[end:]
        self.piece, self.last = self.piece[:start], self.last[: start + 1]
        return self.append(rest)

    def tokens(self) -> list[int]:
        if self.piece in self.vocabulary.ranks:
            return [self.vocabulary.ranks[self.piece]]
        found, end = [], len(self.piece)
        while end:
            found.append(self.last[end])
            end -= len(self.vocabulary.bytes[found[-1]])
        return found[::-1]


class Encoder:
    """Texts to ids and back, each match of `pattern` by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern, self.quick = regex.compile(pattern), quick_pattern(pattern)
        self.pieces = Bounded(self._piece, limit=400_000)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        rank = self.vocabulary.ranks.get(data)
        return (rank,) if rank is not None else tuple(Prefixes(self.vocabulary, data).tokens())

    def encode(self, data: bytes) -> list[int]:
        text = data.decode()
        if self.quick is not None and is_plain(data):
            return list(chain.from_iterable(map(self.pieces.__getitem__, self.quick.findall(text))))
        return list(chain.from_iterable(self.pieces[m.group()] for m in self.pattern.finditer(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker: its memos serve all tasks."""
    return Encoder(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) of every row. A null or empty text has no tokens. `path` is read by each worker."""
    source = pick(docs, id_column, text_column).toDF("doc_id", "text").select("doc_id", whole_text().alias("text"))

    def run(batches):
        code = encoder(path, pattern)
        for batch in slices(batches, "text", 4 << 20):
            ids = [code.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])

    return source.mapInArrow(run, f"doc_id {_kind(source)}, n_tokens bigint, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; `text` is binary, as ids may cut a character. Null ids are no ids."""
    source = pick(rows, id_column, ids_column).toDF("doc_id", "ids")

    def run(batches):
        code = encoder(path, pattern)
        for batch in batches:
            texts = [code.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {_kind(source)}, text binary")


def round_trips(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, as decimals joined by commas, and of the
    bytes that they decode to. No ids leave the task that made them."""
    source = pick(docs, id_column, text_column).toDF("doc_id", "text").select("doc_id", whole_text().alias("text"))

    def run(batches):
        code = encoder(path, pattern)
        decimal = {i: str(i) for i in code.vocabulary.bytes}.__getitem__
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                ids = code.encode(text)
                rows.append((len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(code.decode(ids)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"doc_id {_kind(source)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _kind(source: DataFrame) -> str:
    return source.schema["doc_id"].dataType.simpleString()
