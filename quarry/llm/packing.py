"""Best-fit packing of tokenized documents into sequences, improved by swap-based local search.

A document's token ids, closed by an end id, are cut into pieces of at most ``capacity``
tokens only when they are longer. Full pieces are sequences of their own. The others are
dealt by hash into groups of a bounded number of items, at most one a document; each group is
packed by best fit (longest first) and then searched locally: documents are moved, exchanged one for one or two
for one between underfull sequences whenever that raises the sum of squared fills, until the
emptiest sequences run empty or no step helps.

Only lengths are dealt out, never tokens, and a group is bounded whatever the input, so more
input means more groups. What a group can waste is less than one underfull sequence beyond
what its own lengths force.

Defined results: a null or empty text is the end id alone (one piece of length 1); repeated
rows and null ids are items of their own, told apart by nothing but their place; an empty
table gives no piece; only the id and text columns are read.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from quarry.llm import bpe, common

CAPACITY = 2048
END_ID = 0
#: Items of a group on average; a task holds one group's lengths at a time.
GROUP_ITEMS = 8192
#: Sequence numbers of a group start at its number times this.
_STRIDE = 1 << 32


class WordIds:
    """The library's token ids of texts, as little-endian 32-bit bytes.

    Texts are cut into the runs of characters between white space, which no pretoken crosses.
    Pretokens not met before go through the library's model together; where each chunk's ids
    start in one array is remembered up to a bound.
    """

    #: Words given to the model in one call.
    SLICE = 8192

    def __init__(self, path: str | None = None, memory: int = bpe.MEMORY):
        rules = self.rules = bpe.Rules(path)
        # the same model over words already normalized and cut
        with open(rules.path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        if not rules.suffix:
            raise ValueError("the tokenizer file marks no word ends")
        vocab = spec["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocab.items() if t.endswith(rules.suffix)]] = True
        self.words = Tokenizer.from_str(json.dumps(spec))
        self.alphabet = {b: c for b, c in enumerate(rules.letters) if b != 0x20}
        rules.merges = []  # the model has them
        self.seen = bpe.Seen(most=memory)
        self._forget()

    def _forget(self) -> None:
        self.at = np.zeros(1, np.uint32)  # where each row's ids start; one more for the end
        self.flat = np.zeros(0, np.min_scalar_type(len(self.last)))

    def _model_ids(self, words: list[str]) -> np.ndarray:
        mapped = " ".join(words).encode("utf-8").decode("latin-1").translate(self.alphabet)
        return np.array(self.words.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, chunks: list[str]) -> None:
        """Append the ids of chunks met for the first time."""
        parts = [self.rules.parts(c) for c in chunks]
        words = list(dict.fromkeys(chain.from_iterable(parts)))
        ids = np.concatenate([np.zeros(0, "<u4"), *(self._model_ids(words[i : i + self.SLICE]) for i in range(0, len(words), self.SLICE))])
        size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)  # tokens of each word
        place = dict(zip(words, range(len(words))))
        which = np.fromiter((place[w] for p in parts for w in p), np.int64)
        of_chunk = np.fromiter(map(len, parts), np.int64, len(parts))
        flat, ends = _slices(ids, (np.cumsum(size) - size)[which], size[which])
        self.flat = np.concatenate((self.flat, flat.astype(self.flat.dtype)))
        ends = np.concatenate(([0], ends))[np.cumsum(of_chunk)]
        self.at = np.concatenate((self.at, (int(self.at[-1]) + ends).astype(np.uint32)))

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn."""
        for some in bpe.grouped(texts):
            yield from self._together(some)

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        rules = self.rules
        plain: list[str] = []
        plan: list[list[bytes | None]] = []  # per text: ids as they are, or none for a plain segment
        for t in texts:
            steps: list[bytes | None] = []
            for i, p in enumerate(rules.segments(t)):
                if i % 2:
                    steps.append(_pack([rules.special[p]]))
                elif rules.beyond(p):
                    steps.append(_pack(rules.library.encode(p, add_special_tokens=False).ids))
                else:
                    plain.append(rules.normalized(p))
                    steps.append(None)
            plan.append(steps)
        chunks, starts = bpe.split(plain)
        rows = self.seen.rows(chunks, self._learn, self._forget)
        first = self.at[rows].astype(np.int64)
        flat, ends = _slices(self.flat, first, self.at[rows + 1] - first)
        flat = flat.astype("<u4")
        cuts = (np.concatenate(([0], ends))[starts] * 4).tolist()
        data, done = flat.tobytes(), 0
        for steps in plan:
            out = []
            for step in steps:
                if step is None:
                    step = data[cuts[done] : cuts[done + 1]]
                    done += 1
                out.append(step)
            yield b"".join(out)


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _slices(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` end to end, and where each ends."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


@cache
def _word_ids(path: str | None) -> WordIds:
    """One per worker process; Spark's tasks are the parallelism."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordIds(path)


PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
]))


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_words: bool = True
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32. The ids themselves stay in the
    task; ``token_ids`` gives them where a writer needs them.

    A worker remembers the words it met for its next tasks. ``keep_words=False`` frees them at
    the end of each task, for jobs whose executors go on to other work.
    """
    end = end_id.to_bytes(4, "little")

    def cut(texts: pa.Array) -> pa.Array:
        step, ends, rows = 4 * capacity, [0], []
        for found in _word_ids(path).ids(t.as_py() for t in texts):
            data = memoryview(found + end)
            for k, at in enumerate(range(0, len(data), step)):
                part = data[at : at + step]
                rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            ends.append(len(rows))
        common.give_back()
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, PIECES.elementType.names))

    @F.arrow_udf(PIECES)
    def kept(texts: pa.Array) -> pa.Array:
        return cut(texts)

    @F.arrow_udf(PIECES)
    def freed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(cut, batches)
        _word_ids.cache_clear()
        common.give_back(every=1)

    common.bounded_batches(docs.sparkSession)
    found = (kept if keep_words else freed)(common.col(text_col))
    return docs.select(common.col(id_col).alias("id"), found.alias("p")).select(
        F.col("id").alias(id_col), F.inline("p")
    )


def token_ids(text: Column, path: str | None = None, end_id: int = END_ID) -> Column:
    """A document's ids as ``array<int>``, the end id included."""
    end = end_id.to_bytes(4, "little")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(found + end, "<i4") for found in _word_ids(path).ids(t.as_py() for t in texts)], pa.list_(pa.int32()))

    return ids(text)


class Bins:
    """Sequences of one group, as lists of (length, item) kept by their free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []
        self.room: list[int] = []

    def fill(self, lengths: np.ndarray) -> None:
        """Best fit, longest first: an item goes where least room is left after it."""
        order = np.argsort(-lengths, kind="stable")
        by_room: defaultdict[int, list[int]] = defaultdict(list)
        rooms: list[int] = []  # the sorted distinct rooms of by_room
        for i in order.tolist():
            n = int(lengths[i])
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                b = len(self.items)
                self.items.append([])
                self.room.append(self.capacity)
            else:
                r = rooms[at]
                b = by_room[r].pop()
                if not by_room[r]:
                    del by_room[r], rooms[at]
            self.items[b].append((n, i))
            left = self.room[b] = self.room[b] - n
            if left:
                if left not in by_room:
                    bisect.insort(rooms, left)
                by_room[left].append(b)

    def improve(self) -> None:
        """Local search from the emptiest sequence up, pass after pass until no step helps or
        the free room of all sequences is less than one.

        The source is the emptiest sequence; its partners are in turn all others that are at
        least as full, the emptiest first. A step takes an item x of the source into a partner
        by moving it there, or against one item y < x, or against two items y + z < x, so the
        partner gets fuller and the source emptier by as much: the sum of squared fills
        rises, so the passes end. A source that runs empty is gone.

        A pair without a step is tried again only after one of the two changed, and partners
        of the same lengths once.
        """
        clock = 0  # steps made
        changed, scanned = [0] * len(self.items), [-1] * len(self.items)
        content = [tuple(sorted(n for n, _ in items)) for items in self.items]
        while True:
            under = sorted((b for b, items in enumerate(self.items) if items and self.room[b]), key=lambda b: -self.room[b])
            spare, began = sum(self.room[b] for b in under), clock
            for s in under:
                if spare < self.capacity:
                    return
                if not self.items[s]:
                    continue
                last, scanned[s] = scanned[s], clock
                fresh = changed[s] > last  # else only partners that changed since
                tried: set[tuple[int, ...]] = set()
                for p in under:
                    room = self.room[p]
                    if p == s or not self.items[p] or not 0 < room <= self.room[s] or not (fresh or changed[p] > last) or content[p] in tried:
                        continue
                    while self.items[s] and self.room[p] and self._step(s, p):
                        clock += 1
                        changed[s] = changed[p] = clock
                    if self.room[p] != room:
                        for b in (s, p):
                            content[b] = tuple(sorted(n for n, _ in self.items[b]))
                        tried = set()
                        fresh = True
                    tried.add(content[p])
                    if not self.items[s]:
                        spare -= self.capacity
                        break
            if clock == began:
                return

    def _step(self, s: int, p: int) -> bool:
        """The exchange between source and partner that fills the partner most; None helps: False."""
        room, best, gain = self.room[p], None, 0
        lows = sorted(self.items[p])
        keys = [n for n, _ in lows]
        for x in self.items[s]:
            if gain < x[0] <= room:  # move
                best, gain = (x, ()), x[0]
            # one for one: the least y with x - y <= room
            at = bisect.bisect_left(keys, x[0] - room)
            if at < len(keys) and gain < x[0] - keys[at] <= room:
                best, gain = (x, (lows[at],)), x[0] - keys[at]
            # two for one: the least y + z >= x - room, by two pointers
            i, j = 0, len(keys) - 1
            while i < j:
                d = x[0] - keys[i] - keys[j]
                if d > room:
                    i += 1
                else:
                    if d > gain:
                        best, gain = (x, (lows[i], lows[j])), d
                    j -= 1
            if gain == room:
                break
        if best is None:
            return False
        x, back = best
        self.items[s].remove(x)
        self.items[p].append(x)
        for y in back:
            self.items[p].remove(y)
            self.items[s].append(y)
        self.room[p] -= gain
        self.room[s] += gain
        return True


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each item of one group."""
    bins = Bins(capacity)
    bins.fill(np.asarray(lengths, np.int64))
    bins.improve()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    for items in bins.items:
        if items:
            at = 0
            for n, i in items:
                where[i], offset[i] = number, at
                at += n
            number += 1
    return where, offset


def dealt(items: DataFrame, capacity: int, length_col: str, group_items: int, groups: int) -> tuple[DataFrame, str, str]:
    """``items`` with a group and a place, and the names of these columns.

    Items of ``capacity`` belong to no group of the search: they have numbers below zero, one
    for each run of ``group_items`` places. The others' group follows from a hash of their
    columns; as repeated rows share one hash, a random part that is fixed by the row's place
    deals them out, so no value, however frequent, gathers in one group.
    """
    names = list(items.columns)
    group, at = common.free_name(items, "group"), common.free_name(items, "place")
    numbered = items.withColumn(at, F.monotonically_increasing_id())
    run = F.expr(f"`{at}` div {group_items}")
    by_hash = F.pmod(F.xxhash64(*map(common.col, names), F.spark_partition_id(), common.col(at)), F.lit(groups))
    return numbered.withColumn(group, F.when(common.col(length_col) >= capacity, -1 - run).otherwise(by_hash)), group, at


def pack(items: DataFrame, capacity: int = CAPACITY, length_col: str = "length", group_items: int = GROUP_ITEMS, groups: int | None = None) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: the items of a sequence fill it without gaps.

    ``groups`` is the number of groups of the items below ``capacity``, by default one for each
    ``group_items`` rows (the items are then counted first). A full item is a sequence of its
    own, with a number below zero from its place.
    """
    if groups is None:
        groups = max(1, -(-items.count() // group_items))
    names = list(items.columns)
    salted, group, at = dealt(items, capacity, length_col, group_items, groups)
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(rows: pa.Table) -> pa.Table:
        number = rows[group][0].as_py()
        if number < 0:
            where, offset = -1 - rows[at].to_numpy(), np.zeros(len(rows), np.int64)
        else:
            where, offset = pack_lengths(rows[length_col].to_numpy(), capacity)
            where = where + number * _STRIDE
        placed = [rows[n] for n in names] + [pa.chunked_array([where]), pa.chunked_array([offset])]
        return pa.Table.from_arrays(placed, [*names, "sequence_id", "offset"])

    return salted.groupBy(group).applyInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, group_items: int = GROUP_ITEMS, keep_words: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    The number of groups comes from the number of documents, which costs no tokenization.
    """
    groups = max(1, -(-docs.count() // group_items))
    return pack(pieces(docs, id_col, text_col, capacity, path=path, keep_words=keep_words), capacity, groups=groups)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
