"""Byte-level byte-pair encoding by prefix dynamic programming, and decoding.

Merging by rank gives a byte string exactly one encoding, and a sequence of tokens is that
encoding just when every two neighbours are the encoding of their own bytes and a lone token
that of its own: as long as no merge has crossed the border between two neighbours, their span
goes through the very merges it would go through alone. In a vocabulary whose tokens are made of
tokens of lower rank merges happen in the order of ranks, and two tokens are tested by undoing
the merges at their border, the latest first; in another one by merging their bytes. So every prefix of a string has one
last token: the token that ends there and stays apart from the last token of the prefix it
begins at. ``Prefixes`` stores these last tokens, byte by byte. Bytes appended only add to the
table; after an edit it is computed anew from the edit on, until as many last tokens in a row
as the longest token has bytes are what they were.

Texts are cut into pretokens by the given pattern. A worker remembers the ids of the
pretokens it has met up to a bound, and every new one goes through the table. Decoding joins
the bytes of the tokens.

Defined results: a null or empty text has no ids and decodes to no bytes; special strings are
ordinary text; a pretoken that is itself in the vocabulary is that token; an id that the
vocabulary lacks is an error in decoding; repeated rows are encoded row by row, ids of
documents only pass through; an empty table gives an empty result; only the named columns are
read. Texts and pretokens of any length are encoded whole, with memory in proportion to the
text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

FILE = "byte_bpe_multi_50k.tiktoken"
#: Pretokens, and pairs of tokens, that a worker remembers; beyond it the memory starts anew.
MEMORY = 400_000
#: Characters of texts encoded together; a longer text goes by slices of so many pretokens.
TOGETHER, SLICE = 1 << 20, 1 << 17


def _pattern(text: str) -> regex.Pattern:
    """The cutting pattern with white space as the Unicode property on both of its sides."""
    text = text.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return regex.compile(text, regex.V1)


class Vocabulary:
    """The ranks of a tokenizer file and what follows from them."""

    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(FILE), "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the tokenizer file lacks single bytes")
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.beyond = max(self.bytes) + 1
        self.longest = max(map(len, self.ranks))
        #: By byte string: its token (-1 for none) times two, one more if a longer token ends with it.
        self.endings = {t[i:]: -1 for t in self.ranks for i in range(1, len(t))}
        self.endings = {t: 2 * self.ranks.get(t, -1) + 1 for t in self.endings} | {t: 2 * r + (t in self.endings) for t, r in self.ranks.items()}
        self.apart_of: dict[int, bool] = {}
        #: By token: the pair whose merge makes it; none for single bytes and for tokens that
        #: merging their own bytes does not make.
        self.made = {rank: self._last_merge(token) for token, rank in self.ranks.items() if len(token) > 1}
        # merges happen in the order of ranks if every token is made of tokens of lower rank
        single = {self.ranks[bytes([b])] for b in range(256)}
        self.in_order = all(x in single or x < t for t, pair in self.made.items() if pair for x in pair)
        # all tokens' bytes in one row, for decoding
        ids = np.array(sorted(self.bytes), np.int64)
        sizes = np.zeros(int(ids[-1]) + 1, np.int64)
        sizes[ids] = [len(self.bytes[i]) for i in ids.tolist()]
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.row = np.frombuffer(b"".join(self.bytes[i] for i in ids.tolist()), np.uint8)

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """A short byte string after all merges, lowest rank first, from the left, as long as
        more than ``least`` parts are there."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, self.beyond
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while len(parts) > least:
            rank = min(pairs)
            if rank == none:
                break
            i = pairs.index(rank)
            whole = parts[i] + parts[i + 1]
            parts[i : i + 2] = [whole]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(whole + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + whole, none)
        return parts

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token out of its own bytes."""
        parts = self.merged(token, least=2)
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens stand side by side in an encoding; ``left`` -1 is the start."""
        if len(self.bytes[right]) > 1 and self.made[right] is None:
            return False
        if left < 0:
            return True
        a, b = self.bytes[left], self.bytes[right]
        if a + b in self.ranks:
            return False
        if not self.in_order:
            return self.merged(a + b) == [a, b]
        # back in time: undo the later of the two merges that made the tokens at the border,
        # and see whether the border would have been merged away before it
        made, ranks, whole = self.made, self.ranks, self.bytes
        while True:
            p, q = made.get(left), made.get(right)
            if p is None and q is None:
                return True
            if q is None or p is not None and left > right:
                rank, left = left, p[1]
            else:
                rank, right = right + 1, q[0]  # of equal ranks the left one merges first
            if ranks.get(whole[left] + whole[right], self.beyond) < rank:
                return False

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that token ids stand for."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.sizes) or not (sizes := self.sizes[ids]).all():
            raise ValueError("an id is not in the vocabulary")
        starts = np.cumsum(sizes) - sizes
        return self.row[np.repeat(self.begins[ids] - starts, sizes) + np.arange(int(sizes.sum()))].tobytes()


class Prefixes:
    """The last token of every prefix of a byte string (a pretoken)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last = [-1]  # of the empty prefix: none
        self.append(data)

    def append(self, more: bytes) -> None:
        """The string goes on; what is stored stays."""
        self.data += more
        self._extend(len(self.data))

    def _extend(self, upto: int) -> None:
        """The last tokens of the prefixes that have none yet, up to a length: of the tokens
        that end there, shortest first, the one that stays apart from what stands before it."""
        v, data, last = self.vocabulary, self.data, self.last
        endings, known, most = v.endings, v.apart_of, v.beyond
        if len(known) > MEMORY:
            known.clear()
        for end in range(len(last), upto + 1):
            begin = end - 1
            while True:
                found = endings[data[begin:end]]
                if found >= 0:
                    token, left = found >> 1, last[begin]
                    pair = left * most + token
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = v.apart(left, token)
                    if ok:
                        last.append(token)
                        break
                begin -= 1

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``end``; returns how many
        prefixes were computed anew."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        settled = start + len(new)  # from here on the bytes are the old ones
        same = 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            if same >= self.vocabulary.longest:
                self.last += old[at - shift :]
                return at - 1 - start
            self._extend(at)
            same = same + 1 if at >= settled and self.last[at] == old[at - shift] else 0
        return len(self.data) - start

    def tokens(self) -> list[int]:
        """The encoding, read from the end."""
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes[out[-1]])
        return out[::-1]


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, path: str | None = None, pattern: str | None = None, memory: int = MEMORY):
        self.vocabulary = Vocabulary(path)
        self.cut = _pattern(pattern or public_tokenizers.PATTERN)
        self.memory = memory
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.flat, self.ends = array("i"), array("q", [0])  # the ids met, and where each row's end

    def _learn(self, piece: str) -> None:
        data = piece.encode("utf-8")
        whole = self.vocabulary.ranks.get(data)
        self.flat.extend([whole] if whole is not None else Prefixes(self.vocabulary, data).tokens())
        self.ends.append(len(self.flat))
        self.seen[piece] = len(self.seen)

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pretokens one after the other, and how many each has."""
        if len(self.seen) > self.memory:
            self._forget()
        for piece in set(pieces).difference(self.seen):
            self._learn(piece)
        rows = np.fromiter(map(self.seen.__getitem__, pieces), np.int64, len(pieces))
        ends, flat = np.array(self.ends, np.int64), np.frombuffer(self.flat, np.int32) if self.flat else np.empty(0, np.int32)
        begins = ends[rows]
        sizes = ends[rows + 1] - begins
        starts = np.cumsum(sizes) - sizes
        return flat[np.repeat(begins - starts, sizes) + np.arange(int(sizes.sum()))], sizes

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > TOGETHER:
                yield from self._flush(held)
                held, size = [], 0
                matches = batched(self.cut.finditer(text), SLICE)
                yield np.concatenate([np.empty(0, np.int32), *(self.piece_ids([m.group() for m in some])[0] for some in matches)])
                continue
            held.append(self.cut.findall(text))
            size += len(text)
            if size >= TOGETHER:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        ids, sizes = self.piece_ids([p for pieces in held for p in pieces])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = ends[np.cumsum([0, *map(len, held)])]
        for begin, end in zip(at.tolist(), at[1:].tolist()):
            yield ids[begin:end]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.vocabulary.decode(ids)


@cache
def _encoder(path: str | None, pattern: str | None) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, pattern)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *rows]), pa.int32()))


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The token ids of a text column; ``path`` must exist on every executor."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        out = _lists(list(_encoder(path, pattern).encode_all(t.as_py() for t in texts)))
        common.give_back()
        return out

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The bytes of a column of token ids."""

    @F.arrow_udf("binary")
    def data(rows: pa.Array) -> pa.Array:
        back = _encoder(path, None).decode
        return pa.array([back(np.array(r.as_py() or [], np.int64)) for r in rows], pa.binary())

    return data(ids)


def round_trip(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """A struct of the ids of a text and the bytes that these ids decode to."""

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(texts: pa.Array) -> pa.Array:
        encoder = _encoder(path, pattern)
        rows = list(encoder.encode_all(t.as_py() for t in texts))
        decoded = pa.array(map(encoder.decode, rows), pa.binary())
        out = pa.StructArray.from_arrays([_lists(rows), decoded], ["ids", "decoded"])
        common.give_back()
        return out

    return both(text)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per document: id, ids (array<int>), decoded (binary)."""
    common.bounded_batches(docs.sparkSession)
    read = docs.select(common.col(id_col).alias("id"), round_trip(common.col(text_col).cast("string"), path).alias("both"))
    return read.select(F.col("id").alias(id_col), "both.ids", "both.decoded")


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and the decoded bytes of every document, as digests."""
    done = encode_documents(common.table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
