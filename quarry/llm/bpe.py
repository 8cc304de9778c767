"""Byte-pair merging with a heap over a linked list, for a word-level BPE tokenizer file.

``WordCounter`` counts the tokens of a text without emitting identifiers: a text is cut into
pretokens as the file's normalizer and pretokenizer rules say; each distinct pretoken starts
as one symbol per byte and the adjacent pair of lowest merge rank is merged, again and again,
until no ranked pair is left. The count is the initial symbols minus the merges.

The rules implemented are those such files declare: NFC, white space to one blank, lower
case, a splitting pattern whose matches are kept, the byte-to-character alphabet, a suffix
on a word's last symbol, and special strings matched in the raw text. A file that declares
other rules is refused.
"""

from __future__ import annotations

import heapq
import json
import string
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache, cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from quarry.llm.shingles import span_hashes

FILE = "word_bpe_49k.json"
#: Distinct chunks remembered by a worker; beyond it the memory starts anew. It bounds memory
#: only: what is forgotten is computed again.
MEMORY = 2_500_000


def _alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_MARKS = frozenset(string.punctuation)
#: Separators that splitting takes for white space and the tokenizer's rules do not.
_ODD = "\x1c\x1d\x1e\x1f"


@cache
def _unassigned(char: str) -> bool:
    """Whether Python's Unicode tables do not assign a character."""
    return unicodedata.category(char) == "Cn"


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The runs of characters between white space of all texts, empty ones at a text's ends
    included, and where each text's runs begin (one more for the end)."""
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
    return lists.values, lists.offsets.to_numpy()


def _pattern(text: str) -> regex.Pattern:
    """The file's splitting pattern; ``\\s`` is the Unicode property, without U+001C-U+001F."""
    return regex.compile(text.replace(r"[^\s", r"[^\p{White_Space}"), regex.V1)


class Rules:
    """The cutting rules and merges of one tokenizer file."""

    def __init__(self, path: str | None = None):
        self.path = path or public_tokenizers.path(FILE)
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if (
            steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]
            or pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["add_prefix_space"] or pre[1]["use_regex"]
            or model["type"] != "BPE" or model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"]
            or any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        ):
            raise ValueError("the tokenizer file declares rules that are not implemented")
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: list = model["merges"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cut = _pattern(pre[0]["pattern"]["Regex"]).findall
        self.letters = _alphabet()

    def segments(self, text: str) -> list[str]:
        """Raw text and special strings in turn: odd places hold the special strings."""
        return self.at_special.split(text) if any(s in text for s in self.special) else [text]

    def normalized(self, segment: str) -> str:
        """A text without special strings as the tokenizer's rules normalize it. No pretoken
        reaches over white space, so its runs between white space can be cut one by one."""
        if not segment.isascii():
            segment = unicodedata.normalize("NFC", segment)
            if "Σ" in segment:  # one character at a time: lower case does not depend on the neighbours
                return "".join(c.lower() for c in segment)
        return segment.lower()

    def beyond(self, segment: str) -> bool:
        """Whether the library itself must cut a text: it holds odd separators or characters
        that Python's Unicode tables lack and the library may know."""
        if any(c in segment for c in _ODD):
            return True
        if segment.isascii():
            return False
        try:
            segment.encode("latin-1")
        except UnicodeEncodeError:
            return any(map(_unassigned, set(segment)))
        return False

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        """The rank of each mergeable pair."""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in self.merges)
        return {m: i for i, m in enumerate(pairs)}

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def library_words(self, segment: str) -> list[str]:
        value = {c: b for b, c in enumerate(self.letters)}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
        return [bytes(map(value.__getitem__, w)).decode() for w, _ in words]

    def parts(self, chunk: str) -> list[str]:
        """The pretokens of a chunk. A run of letters, with or without one mark after it, is
        what nearly all chunks are; the file's pattern cuts the rest."""
        if not chunk:
            return []
        if chunk.isalpha():
            return [chunk]
        if chunk[-1] in _MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.cut(chunk)

    def symbols(self, word: str) -> list[str]:
        """A pretoken's initial symbols: one per UTF-8 byte, the last with the word-end suffix."""
        out = [self.letters[b] for b in word.encode("utf-8")]
        out[-1] += self.suffix
        return out


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank any more.

    The symbols form a doubly linked list; the heap holds the ranked adjacent pairs as
    (rank, place). A popped pair is stale when a symbol at its place has changed since.
    Equal ranks merge from the left. O(n log n) in the length of the word.
    """
    n = len(symbols)
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((parts[i], parts[i + 1]))
        if rank is not None:
            heap.append((rank, i, parts[i], parts[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = ranks.get((parts[i], parts[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((parts[h], parts[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, parts[h], parts[i]))
    return n - merges


class Seen:
    """Row numbers of the texts met so far, by 96-bit hash in an open-addressing table: some
    twenty bytes a text instead of the text. Holds ``MEMORY`` texts, then starts anew."""

    def __init__(self, bits: int = 22, most: int = MEMORY):
        self.mask, self.most = np.uint64((1 << bits) - 1), min(most, (1 << bits) * 3 // 4)
        self.forget()

    def forget(self) -> None:
        size = int(self.mask) + 1
        self.n = 0
        self.row, self.key, self.check = np.full(size, -1, np.int32), np.zeros(size, np.uint64), np.zeros(size, np.uint32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The row of each text, -1 for those not met."""
        out, at, todo = np.full(len(key), -1, np.int64), (key & self.mask).astype(np.int64), np.arange(len(key))
        while len(todo):
            slot = at[todo]
            row = self.row[slot]
            hit = (row >= 0) & (self.key[slot] == key[todo]) & (self.check[slot] == check[todo])
            out[todo[hit]] = row[hit]
            todo = todo[(row >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & int(self.mask)
        return out

    def add(self, key: np.ndarray, check: np.ndarray) -> None:
        """Give the next rows to texts that were not met, in order."""
        at, todo = (key & self.mask).astype(np.int64), np.arange(len(key))
        while len(todo):
            free = todo[self.row[at[todo]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.row[slots], self.key[slots], self.check[slots] = self.n + won, key[won], check[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & int(self.mask)
        self.n += len(key)

    def rows(self, chunks: pa.Array, learn: Callable[[list[str]], None], forget: Callable[[], None]) -> np.ndarray:
        """The row of each chunk; ``learn`` is told the chunks that get the next rows."""
        if not len(chunks):
            return np.empty(0, np.int64)
        coded = chunks.dictionary_encode()
        texts = coded.dictionary
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        spans = np.frombuffer(data, np.uint8), ends[:-1], ends[1:]
        key, check = span_hashes(*spans, salt=0), span_hashes(*spans, salt=1).astype(np.uint32)
        found = self.find(key, check)
        new = np.flatnonzero(found < 0)
        if self.n + len(new) > self.most:
            size = max(len(self.row), 1 << int(2 * len(texts)).bit_length())
            self.mask = np.uint64(size - 1)
            self.forget()
            forget()
            new = np.arange(len(texts))
        if len(new):
            found[new] = self.n + np.arange(len(new))
            learn(texts.take(pa.array(new)).to_pylist())
            self.add(key[new], check[new])
        return found[coded.indices.to_numpy()]


#: Characters of text whose chunks are looked up together.
TOGETHER = 1 << 20


def grouped(texts: Iterable[str | None], size: int = TOGETHER) -> Iterator[list[str]]:
    """Texts in lists of about ``size`` characters; null is an empty text."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class WordCounter:
    """Counts the tokens of whole texts."""

    def __init__(self, path: str | None = None, memory: int = MEMORY):
        self.rules = Rules(path)
        self.seen = Seen(most=memory)
        self._forget()

    def _forget(self) -> None:
        self.each = np.zeros(0, np.int64)  # tokens of each chunk met

    def _word(self, word: str) -> int:
        return merge_count(self.rules.symbols(word), self.rules.ranks)

    def _learn(self, chunks: list[str]) -> None:
        counts: dict[str, int] = {}
        out = []
        for c in chunks:
            n = 0
            for w in self.rules.parts(c):
                if w not in counts:
                    counts[w] = self._word(w)
                n += counts[w]
            out.append(n)
        self.each = np.concatenate((self.each, np.array(out, np.int64)))

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        """The number of tokens of each text in turn."""
        rules = self.rules
        for some in grouped(texts):
            plain: list[str] = []
            ends, more = [], []  # where a text's plain segments end; tokens besides them
            for t in some:
                parts = rules.segments(t)
                besides = len(parts) // 2
                for p in parts[::2]:
                    if rules.beyond(p):
                        besides += sum(map(self._word, rules.library_words(p)))
                    else:
                        plain.append(rules.normalized(p))
                ends.append(len(plain))
                more.append(besides)
            chunks, starts = split(plain)
            rows = self.seen.rows(chunks, self._learn, self._forget)
            sums = np.concatenate(([0], np.cumsum(self.each[rows])))[starts[[0, *ends]]]
            yield from (np.diff(sums) + np.array(more, np.int64)).tolist()

    def count(self, text: str | None) -> int:
        return next(self.counts([text]))
