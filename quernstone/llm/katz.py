"""Katz backoff language model of any order: Good-Turing discounted counts over a partitioned corpus.

Texts are kept in chunks of a few megabytes.  A chunk asks the partition of each
of its words for its count in the training texts, then that of each of its word
pairs, then of each of its triples, up to the model's order, in one packed message
for each partition, and gets one packed answer; no task holds more than one chunk
or one partition.  Partitions number what they count, so that a context is a
number at the next order, and write the counts to a table for each order.

What follows a context that one chunk alone has is counted there and asked of
nobody.  A context that is too frequent to be in one partition is spread over
several by the words after it, and its sums are added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Store
from .shingles import mix

CHUNK_BYTES = 4 << 20
ORDER = 3
#: Counts above K are not discounted.
K = 5
HOT = 50_000
ASKED_PARTS = 8
#: Kinds of rows: chunks and their word lists, and for order k, as 10 k + kind, what is asked, answered, counted and summed.
CHUNK, LISTED = 0, 1
ASK, ANSWER, COUNTED, ASKED, CONTEXTS, SUMMED = range(2, 8)
PARTS = "kind int, chunk long, bucket int, a binary, b binary, c binary, d binary"
_FIELDS = [("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def loosen(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, in as many planes as the largest needs."""
    wide = 8 if len(numbers) and numbers.min() < 0 else max(1, -(-int(numbers.max()).bit_length() // 8)) if len(numbers) else 1
    narrow = np.ascontiguousarray(numbers, next(f"<i{n}" if n == 8 else f"<u{n}" for n in (1, 2, 4, 8) if n >= wide))
    planes = narrow.view(np.uint8).reshape(-1, narrow.itemsize).T
    return bytes([wide]) + squeeze(planes[:wide].tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(loosen(packed[1:]), np.uint8).reshape(packed[0], -1)
    out = planes[0].astype("<i8")
    for k in range(1, packed[0]):
        out |= planes[k].astype("<i8") << 8 * k
    return out


def places(at: np.ndarray, size: int) -> bytes:
    """Token places as ranks by frequency, which pack better, after the frequencies."""
    often = np.bincount(at, minlength=size)
    rank = np.empty(size, np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(size)
    first = pack(often)
    return len(first).to_bytes(4, "little") + first + pack(rank[at])


def unplaced(packed: bytes) -> tuple[np.ndarray, int]:
    """(token places, number of words) from ``places``."""
    cut = 4 + int.from_bytes(packed[:4], "little")
    often = unpack(packed[4:cut])
    return np.argsort(-often, kind="stable")[unpack(packed[cut:])], len(often)


def tokens(texts: pa.Array) -> pa.ListArray:
    """The words of each text between ASCII white space, with A-Z in lower case, then its end, the empty word; null is empty."""
    text = pa.scalar("", pa.large_string())
    words = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), text)))
    ended = pc.binary_join_element_wise(words, pa.scalar(" ", pa.large_string()), text)
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(words, text), text, ended))


def held_out(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts d[r] for r = 1..K by Katz's formula, from the numbers of items seen r times.

    Where the numbers of a small corpus give none in (0, 1), d[r] is 1 - 1/2r.
    """

    d: tuple[float, ...]

    @classmethod
    def of(cls, seen: list[int]) -> Discounts:
        n = [0, *seen]
        out = []
        for r in range(1, K + 1):
            d = -1.0
            if n[r] and n[1]:
                common = (K + 1) * n[K + 1] / n[1]
                if common != 1:
                    d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            out.append(d if 0 < d < 1 else 1 - 0.5 / r)
        return cls(tuple(out))

    def kept(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return count * np.asarray([1.0, *self.d, 1.0])[np.minimum(count, K + 1)]

    def mass(self, classes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Sum of discounted counts: ``classes[..., r-1]`` items have count r, ``rest`` is the sum of larger counts."""
        return classes @ (np.arange(1, K + 1) * np.asarray(self.d)) + rest


@dataclass(frozen=True)
class Unigrams:
    """Discounted word probabilities; what is left is the probability of any unknown word.

    If nothing is discounted one count is added for it, so that it is never 0.
    """

    total: int
    types: int
    discounts: Discounts
    left: float
    size: float

    @classmethod
    def of(cls, total: int, types: int, seen: list[int], rest: int) -> Unigrams:
        discounts = Discounts.of(seen)
        mass = float(discounts.mass(np.asarray(seen[:K], float), np.float64(rest)))
        size = float(total) if total - mass > 1e-9 else total + 1.0
        return cls(total, types, discounts, 1 - mass / size, size)

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts.kept(count) / self.size, self.left)


def backoff(upper: Discounts, lower: Discounts, lower_size: np.ndarray | float, count: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, weight) of contexts: p(w | h) = d(c)c/size if seen, else weight * p(w | shorter h).

    ``count`` is how often h precedes a word; ``sums`` has for the words seen after
    h how many counts are 1..K, the sum of larger counts, and the same of the
    counts after the shorter context, whose size is ``lower_size``.  The weight
    makes the probabilities add up to 1 exactly.
    """
    mass = upper.mass(sums[:, :K].astype(float), sums[:, K].astype(float))
    size = np.where(count - mass > 1e-9, count, count + 1).astype(float)
    taken = lower.mass(sums[:, K + 1 : 2 * K + 1].astype(float), sums[:, 2 * K + 1].astype(float)) / lower_size
    return size, (1 - mass / size) / (1 - taken)


def context_sums(at: np.ndarray, total: np.ndarray, lower: np.ndarray, contexts: int) -> np.ndarray:
    """The ``sums`` of ``backoff`` for contexts 0..n from grams: which context each has, its count and that of its shorter gram."""
    sums, seen = np.zeros((contexts, 2 * K + 2), np.int64), np.flatnonzero(total > 0)
    own = at[seen]
    for k, value in enumerate((total[seen], lower[seen])):
        small = np.minimum(value, K + 1)
        counts = np.bincount(own * (K + 2) + small, minlength=contexts * (K + 2)).reshape(contexts, K + 2)
        sums[:, k * (K + 1) : k * (K + 1) + K] = counts[:, 1 : K + 1]
        large = np.flatnonzero(small > K)
        if len(large):
            sums[:, k * (K + 1) + K] = np.bincount(own[large], weights=value[large], minlength=contexts)
    return sums


def sums_of(some: np.ndarray, at: np.ndarray, total: np.ndarray, lower: np.ndarray, contexts: int) -> np.ndarray:
    """The rows of ``context_sums`` of some contexts, in their order."""
    place = np.full(contexts, -1)
    place[some] = np.arange(len(some))
    own = np.flatnonzero((place >= 0)[at])
    return context_sums(place[at[own]], total[own], lower[own], len(some))


def count_figures(total: np.ndarray) -> np.ndarray:
    return np.asarray([int((total == r).sum()) for r in range(1, K + 2)])


def _chunks(id_type: pa.DataType, chunk_bytes: int):
    """Texts to chunks of two rows.

    LISTED has a = distinct words by their hash, the end of a text, the empty word,
    first, and b = their counts in training texts; CHUNK has b = tokens as places
    among these, c = tokens of each text and d = ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def out() -> pa.RecordBatch:
            id_array = pa.concat_arrays([part.column(0).cast(id_type) for part in held])
            words_by_text = tokens(pa.concat_arrays([part.column(1) for part in held]))
            coded = pa.concat_arrays([pa.array([""], pa.large_string()), words_by_text.flatten()]).dictionary_encode()
            seen = coded.dictionary.cast(pa.large_binary()).to_pylist()
            order = np.argsort(np.fromiter(map(zlib.crc32, seen), np.int64, len(seen)), kind="stable")
            rank = np.empty(len(seen), np.int64)
            rank[order] = np.arange(len(seen))
            at, words = rank[coded.indices.to_numpy()[1:]], [seen[k] for k in order.tolist()]
            ids = pa.RecordBatch.from_arrays([id_array], ["id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids.schema) as writer:
                writer.write_batch(ids)
            n = pc.list_value_length(words_by_text).to_numpy().astype(np.int64)
            trained = np.repeat([not held_out(i) for i in id_array.to_pylist()], n)
            counts = np.bincount(at[trained], minlength=len(words))
            row = task << 32 | nth
            rows = [(LISTED, row, -1, squeeze(b"\n".join(words)), pack(counts), None, None), (CHUNK, row, -1, None, places(at, len(words)), pack(n), squeeze(sink.getvalue().to_pybytes()))]
            return _rows(rows).to_batches()[0]

        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 1)])
            at = 0
            while at < batch.num_rows:
                end = min(int(np.searchsorted(upto, upto[at] + chunk_bytes - size)), batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += int(upto[end] - upto[at])
                at = end
                if size >= chunk_bytes:
                    yield out()
                    nth, held, size = nth + 1, [], 0
        if held:
            yield out()

    return run


@dataclass
class Grams:
    """The different grams of one order in a chunk: which one ends at each token (-1: its context is unknown), and of each its number, its count in training, if no other chunk has it, and if all that follows its context is too frequent to be discounted."""

    at: np.ndarray
    gid: np.ndarray
    count: np.ndarray
    alone: np.ndarray
    heavy: np.ndarray

    @cached_property
    def ranks(self) -> np.ndarray:
        return ranks(self.gid)


class Chunk:
    """A chunk's tokens, opened."""

    def __init__(self, b: bytes, c: bytes, d: bytes):
        (self.at, self.size), self.n = unplaced(b), unpack(c)
        self.ids = pa.ipc.open_stream(loosen(d)).read_all().column(0).combine_chunks()
        self.held = np.asarray([held_out(i) for i in self.ids.to_pylist()], bool)
        self.trained = np.repeat(~self.held, self.n)
        self.starts = np.cumsum(self.n) - self.n

    def longer(self, words: Grams, lower: Grams, order: int, buckets: int, hot: int) -> Longer:
        """The grams of an order from those of the order before, by bucket and then by numbers.

        Before a text's first word is the end of a text, and nothing before that.
        """
        before = np.concatenate([[-1], lower.at[:-1]])
        before[self.starts] = 0 if order == 2 else -1
        ok = np.flatnonzero((before >= 0) & (lower.count[before] > 0))
        context, word = before[ok], self.at[ok]
        salt = lower.gid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        home = (mix(salt) % np.uint64(buckets)).astype(np.int64)
        home[lower.alone] = -1
        bucket = home[context]
        spread = (lower.count > hot) & ~lower.alone
        if spread.any():
            to = np.flatnonzero(spread[context])
            over = context[to]
            part = mix(words.gid[word[to]].astype(np.uint64)) % (-(-lower.count // hot)).astype(np.uint64)[over]
            bucket[to] = (mix(salt[over] + part) % np.uint64(buckets)).astype(np.int64)
        first, back = ordered(bucket + 1, lower.ranks[context], words.ranks[word])
        at = np.full(len(self.at), -1)
        at[ok] = back
        local = np.bincount(back[self.trained[ok]], minlength=len(first))
        return Longer(at, context[first], word[first], lower.at[ok][first], bucket[first], local)


def ranks(numbers: np.ndarray) -> np.ndarray:
    """The place of each number when they are sorted."""
    out = np.empty(len(numbers), np.int64)
    out[np.argsort(numbers)] = np.arange(len(numbers))
    return out


def ordered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each different tuple of keys, in order; which of these each row has); keys are not negative."""
    if not len(keys[0]):
        return (np.zeros(0, np.int64),) * 2
    bits = [int(k.max()).bit_length() for k in keys]
    if sum(bits) < 64:
        key = keys[0]
        for k, n in zip(keys[1:], bits[1:], strict=True):
            key = key << n | k
        sort = np.argsort(key)
        new = np.concatenate([[True], np.diff(key[sort]) != 0])
    else:
        sort = np.lexsort(keys[::-1])
        new = np.concatenate([[True], np.any([np.diff(k[sort]) != 0 for k in keys], axis=0)])
    back = np.empty(len(sort), np.int64)
    back[sort] = np.cumsum(new) - 1
    return sort[new], back


def flagged(at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[at] = True
    return out


def distinct(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different values, which of these each is) of sorted values."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return sorted_values[new], np.cumsum(new) - 1


@dataclass
class Longer:
    """Grams of a chunk before their counts are known: context, word and shorter gram of each (places in the chunk), its bucket (-1: no other chunk has the context) and its count in the chunk's training texts."""

    at: np.ndarray
    context: np.ndarray
    word: np.ndarray
    shorter: np.ndarray
    bucket: np.ndarray
    local: np.ndarray

    def answered(self, answers: list[tuple]) -> Grams:
        """The grams with the counts and numbers that (bucket, a, b, c) rows, sorted, give for those that were asked."""
        mine = int(np.searchsorted(self.bucket, 0))
        got = np.concatenate([unpack(x[1]) for x in answers]) if answers else np.zeros(0, np.int64)
        gid = np.concatenate([np.cumsum(unpack(x[3])) for x in answers]) if answers and answers[0][3] else np.zeros(len(got), np.int64)
        own = self.local[:mine]
        flags = lambda bit, here: np.concatenate([np.full(mine, here), (got & bit) > 0])
        return Grams(self.at, np.concatenate([-np.cumsum(own > 0), gid]), np.concatenate([own, got >> 2]), flags(2, True), flags(1, False))


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of equal values."""
    if len(sorted_values):
        start = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
        yield from zip(sorted_values[start].tolist(), start.tolist(), [*start[1:].tolist(), len(sorted_values)], strict=True)


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, n = loosen(a).split(b"\n"), unpack(b)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) * buckets >> 32
                rows = [(10 + ASK, chunk, k, squeeze(b"\n".join(words[s:e])), pack(n[s:e]), None, None) for k, s, e in _runs(bucket)]
                yield from _rows(rows).to_batches()

    return run


def _answer_words(buckets: int):
    """Counts of a partition's words over all chunks.

    Ids are unique over all partitions; frequent words get small ones, which pack better.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        own = [loosen(a) for a in table.column("a").to_pylist()]
        sizes, raw = [x.count(b"\n") + 1 for x in own], b"\n".join([*own, b""])
        # words with the line break that ends each, where they lie
        cut = np.concatenate([[0], np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1]).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(raw)]).dictionary_encode()
        at = coded.indices.to_numpy()
        total = np.bincount(at, weights=np.concatenate([unpack(b) for b in table.column("b").to_pylist()])).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, total, at = b"".join(coded.dictionary.take(pa.array(order)).to_pylist())[:-1], total[order], rank[at]
        alone, at = np.bincount(at) == 1, np.split(at, np.cumsum(sizes)[:-1])
        rows = [(10 + ANSWER, c, bucket, pack(total[k] * 4 + alone[k] * 2), None, pack(k * buckets + bucket), None) for c, k in zip(chunks, at, strict=True)]
        figures = [int(total.sum()), int((total > 0).sum()), *count_figures(total), int(total[total > K].sum())]
        return _rows([*rows, (10 + COUNTED, None, bucket, squeeze(words), pack(total), None, pack(np.asarray(figures)))])

    return run


class Opened:
    """The chunk among the rows gathered for it, with its grams of each order that has answers."""

    def __init__(self, table: pa.Table, order: int, buckets: int, hot: int):
        self.kind = np.asarray(table.column("kind").to_pylist())
        self.columns = {c: table.column(c).to_pylist() for c in ("chunk", "bucket", "a", "b", "c", "d")}
        self.chunk = self.columns["chunk"][0]
        self.own = Chunk(*self.pick(CHUNK, "b", "c", "d")[0])
        answers = sorted(self.pick(10 + ANSWER, "bucket", "a", "b", "c"))
        got, gid = (np.concatenate([unpack(x[k]) for x in answers]) for k in (1, 3))
        words = Grams(self.own.at, gid, got >> 2, (got & 2) > 0, np.zeros(len(got), bool))
        self.grams, self.longer = [words], []
        for k in range(2, order + 1):
            self.longer.append(self.own.longer(words, self.grams[-1], k, buckets, hot))
            self.grams.append(self.longer[-1].answered(sorted(self.pick(10 * k + ANSWER, "bucket", "a", "b", "c"))))

    def pick(self, kind: int, *columns: str) -> list[tuple]:
        return [tuple(self.columns[c][i] for c in columns) for i in np.flatnonzero(self.kind == kind)]


def _ask(order: int, buckets: int, hot: int):
    """Messages about the grams of an order, one a bucket, and the counts of those that no other chunk can have."""

    def run(table: pa.Table) -> pa.Table:
        got = Opened(table, order - 1, buckets, hot)
        words, lower = got.grams[0], got.grams[-1]
        new = got.own.longer(words, lower, order, buckets, hot)
        context, word = lower.gid[new.context], words.gid[new.word]
        rows, mine = [], int(np.searchsorted(new.bucket, 0))
        if mine:
            seen = np.flatnonzero(new.local[:mine])
            rows.append((10 * order + COUNTED, got.chunk, -1, pack(np.diff(context[seen], prepend=0)), pack(word[seen]), pack(new.local[seen]), pack(count_figures(new.local[:mine]))))
        # d: the shorter gram's count where the gram is seen here in training, and which contexts are spread
        flags = lower.count[new.context] > hot
        shorter = np.where(new.local > 0, lower.count[new.shorter], 0) * 2 + flags
        rows += [(10 * order + ASK, got.chunk, k, pack(np.diff(context[s:e], prepend=0)), pack(word[s:e]), pack(new.local[s:e]), pack(shorter[s:e])) for k, s, e in _runs(new.bucket) if k >= 0]
        return _rows(rows)

    return run


def _answer(order: int, buckets: int, last: bool):
    """Counts of a partition's grams and sums for its contexts, over all chunks.

    Grams are numbered unless the order is the last; those not seen in training
    need no number.  Sums of contexts that are spread over partitions go out by
    context, to be added up for the chunks that ask.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket, chunks = table.column("bucket")[0].as_py(), table.column("chunk").to_pylist()
        if bucket < 0:
            return table
        parts = [[unpack(x) for x in table.column(c).to_pylist()] for c in "abcd"]
        sizes = np.asarray([len(x) for x in parts[0]])
        v, w, n = np.concatenate([np.cumsum(x) for x in parts[0]]), np.concatenate(parts[1]), np.concatenate(parts[2])
        shorter, spread = np.divmod(np.concatenate(parts[3]), 2)
        del parts
        first, gram = ordered(v, w)
        said = np.bincount(gram, weights=shorter > 0)
        shorter = (np.bincount(gram, weights=shorter) / np.maximum(said, 1)).round().astype(np.int64)  # all that say it say the same
        total = np.bincount(gram, weights=n).astype(np.int64)
        alone = np.bincount(gram) == 1
        context, at = distinct(v[first])
        sums = context_sums(at, total, shorter, len(context))
        seen = total > 0
        number = np.maximum(np.cumsum(seen) - 1, 0) * buckets + bucket
        hot = np.zeros(len(context), bool)
        hot[at[spread[first] > 0]] = True
        heavy = (sums[:, :K].sum(axis=1) == 0) & ~hot
        rows, answer, uses = [], total * 4 + alone * 2 + heavy[at], np.bincount(at, weights=total, minlength=len(context)).astype(np.int64)
        for chunk, s, e in zip(chunks, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
            own = gram[s:e]
            held, to = distinct(at[own])  # a chunk asks in the order of the numbers
            # sums for the weights of contexts before a gram never seen, less what the chunk's own grams tell: nothing if they are all that follows
            here = total[own]
            unseen = flagged(to[here == 0], len(held))
            more = np.flatnonzero(unseen & (uses[held] > np.bincount(to, weights=here)) & ~hot[held])
            rest = sums[held[more]] - sums_of(more, to, here, shorter[own], len(held))
            rows.append((10 * order + ANSWER, chunk, bucket, pack(answer[own]), pack(rest.T.ravel()), None if last else pack(np.diff(number[own], prepend=0)), None))
            if hot[held].any():
                rows.append((10 * order + ASKED, chunk, bucket, None, None, None, context[held[hot[held]]].tobytes()))
        if hot.any():
            rows.append((10 * order + CONTEXTS, None, bucket, None, None, sums[hot].tobytes(), context[hot].tobytes()))
        rows.append((10 * order + COUNTED, None, bucket, pack(np.diff(v[first][seen], prepend=0)), pack(w[first][seen]), pack(total[seen]), pack(count_figures(total))))
        return _rows(rows)

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, chunk, sums) of what is packed in ASKED and CONTEXTS rows."""
    for batch in batches:
        for chunk, c, d in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            v = np.frombuffer(d, np.int64)
            sums = None if c is None else np.frombuffer(c, np.int64).reshape(len(v), -1)
            flat = pa.nulls(len(v), pa.list_(pa.int64())) if sums is None else pa.array(sums.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array([chunk] * len(v), pa.int64()), flat], ["v", "chunk", "sums"])


def _score(order: int, buckets: int, hot: int, words: Unigrams, discounts: list[Discounts], id_col: str, id_type: pa.DataType):
    """Scores of a chunk's texts: ``discounts`` has those of order 1, 2, ..."""

    def run(table: pa.Table) -> pa.Table:
        got = Opened(table, order, buckets, hot)
        own, count = got.own, got.grams[0].count
        p = words.p(count)[own.at]
        size: np.ndarray | float = words.size
        for k in range(2, order + 1):
            lower, new, grams = got.grams[k - 2], got.longer[k - 2], got.grams[k - 1]
            contexts = len(lower.count)
            uses = np.bincount(new.context, weights=grams.count, minlength=contexts)
            unseen, heavy, discounted = (flagged(new.context[x], contexts) for x in (grams.count == 0, grams.heavy, (grams.count > 0) & (grams.count <= K)))
            heavy |= lower.alone & (uses > 0) & ~discounted
            # weights are asked of contexts before a gram never seen, and sizes of all: the count, and one more where nothing is discounted
            weighed = np.flatnonzero(unseen | (lower.count > hot))
            place = np.full(contexts, -1)
            place[weighed] = np.arange(len(weighed))
            sums = sums_of(weighed, new.context, grams.count, lower.count[new.shorter], contexts)
            asked = ((s, e) for bucket, s, e in _runs(new.bucket) if bucket >= 0)
            for (s, e), (_, b) in zip(asked, sorted(got.pick(10 * k + ANSWER, "bucket", "b")), strict=True):
                held = new.context[s:e][np.concatenate([[True], new.context[s + 1 : e] != new.context[s : e - 1]])]
                more = held[unseen[held] & (lower.count[held] > uses[held]) & (lower.count[held] <= hot)]
                sums[place[more]] += unpack(b).reshape(2 * K + 2, -1).T
            if summed := got.pick(10 * k + SUMMED, "d"):
                rows = np.asarray([np.frombuffer(x, np.int64) for (x,) in summed])
                spread = np.flatnonzero(lower.count > hot)  # grams never seen have numbers of others
                by_id = spread[np.argsort(lower.gid[spread])]
                sums[place[by_id[np.searchsorted(lower.gid[by_id], rows[:, 0])]]] = rows[:, 1:]
            # the size of the context without its first word
            shorter = size if k == 2 else size[got.longer[k - 3].shorter[weighed]]
            size, weight = (np.maximum(lower.count, 1) + heavy).astype(float), np.zeros(contexts)
            size[weighed], weight[weighed] = backoff(discounts[k - 1], discounts[k - 2], shorter, np.maximum(lower.count[weighed], 1), sums)
            known = np.flatnonzero(new.at >= 0)
            at = new.at[known]
            c, context = grams.count[at], new.context[at]
            p[known] = np.where(c > 0, discounts[k - 1].kept(c) / size[context], weight[context] * p[known])
        base = np.log10((count + 0.5) / (words.total + 0.5 * (words.types + 1)))
        by_text = lambda x: np.add.reduceat(x, own.starts)
        known = by_text((count > 0)[own.at].astype(np.int64))
        columns = [own.ids, pa.array(own.held), pa.array(own.n), pa.array(known), pa.array(np.full(len(own.n), words.total)), pa.array(by_text(base[own.at])), pa.array(by_text(np.log10(p)))]
        return pa.Table.from_arrays([columns[0].cast(id_type), *columns[1:]], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _figures(rows: DataFrame, kind: int) -> np.ndarray:
    """Sums of the figures that each partition packs in ``d``: a few numbers a partition, added up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in batch.column(0).to_pylist():
                got = unpack(d)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got), dtype=np.int32)), pa.array(got)], ["k", "n"])

    got = rows.where(F.col("kind") == kind).select("d").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return np.asarray([r["n"] for r in sorted(got, key=lambda r: r["k"])], np.int64)


def _of(rows: DataFrame, kind: int) -> DataFrame:
    return rows.where(F.col("kind") == kind).select(*(c for c, _ in _FIELDS))


def _summed(level: DataFrame, order: int) -> DataFrame:
    """For each chunk that asks for a context that is spread over partitions its sums, added up."""
    listed = lambda kind: _of(level, 10 * order + kind).select("chunk", "c", "d").mapInArrow(_listed, "v long, chunk long, sums array<long>")
    summed = listed(CONTEXTS).groupBy("v").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(2 * K + 2)))
    wanted = listed(ASKED).select("v", "chunk").distinct().join(summed, "v").select("chunk", "v", *(f"s{k}" for k in range(2 * K + 2)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            if len(rows):
                yield from _rows([(10 * order + SUMMED, c, -1, None, None, None, r.tobytes()) for c, r in zip(batch.column(0).to_pylist(), rows, strict=True)]).to_batches()

    return wanted.mapInArrow(packed, PARTS)


def _passes(gathered: DataFrame, n: int) -> list[DataFrame]:
    """What is gathered for chunks, in parts that have whole chunks."""
    return [gathered.where(F.pmod(F.xxhash64("chunk"), F.lit(n)) == k) for k in range(n)] if n > 1 else [gathered]


def count_tables(store: Store, order: int) -> list[DataFrame]:
    """The stored counts of training texts for each order: (chunk, bucket, a, b, c).

    Of words, a has the words and b their counts, packed; the number of the i-th
    is i times the number of partitions, plus its bucket.  Of longer grams, a has the differences of the numbers
    of their contexts, b the numbers of their last words and c their counts; the i-th is numbered like a word, or, where a chunk alone
    has them, -1 - i, a number of that chunk's own.
    """
    of = lambda k: _of(store.spark.read.schema(PARTS).parquet(f"{store.base}/order-{k}"), 10 * k + COUNTED).select("chunk", "bucket", "a", "b", "c")
    return [of(k) for k in range(1, order + 1)]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT, store: Store | None = None) -> DataFrame:
    """Trains on the texts that are not held out and scores all: one row a document.

    A text is its words and one end; ``score`` is its log10 probability, each token
    given up to ``order`` - 1 tokens before it, of which the first is a text's end.
    A gram seen in training has its discounted share of its context; else the
    probability by the context without its first word is weighted, or stands alone
    if the context is unknown; a word never seen in training has the probability
    of an unknown word.  ``base_score`` adds up log10((c + 0.5) / (N + 0.5 (V + 1))).

    Null texts count as empty (one end), null ids as the empty id when texts are
    held out, repeated rows count each; an empty table gives no rows; texts of any
    length are taken whole, a long one being a chunk of its own; other columns
    are ignored.  Contexts that precede more than ``hot`` tokens are spread.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark, store = docs.sparkSession, store or Store(docs.sparkSession, "katz")
    source = docs.select(id_col, text_col)
    id_type = source.limit(0).toArrow().schema.field(0).type
    id_ddl = source.schema[id_col].dataType.simpleString()
    stored = store.put(source.mapInArrow(_chunks(id_type, chunk_bytes), PARTS), "chunks", "kind")
    chunks = _of(stored, CHUNK)
    n = chunks.count()
    word_buckets, buckets = max(1, n // 6), max(1, n // 2)

    asked = _of(stored, LISTED).select("chunk", "a", "b").mapInArrow(_ask_words(word_buckets), PARTS)
    level = store.put(asked.groupBy("bucket").applyInArrow(_answer_words(word_buckets), PARTS), "order-1")
    got = _figures(level, 10 + COUNTED)
    total, types, *seen, rest = got.tolist() if len(got) else [0] * (K + 4)
    words = Unigrams.of(total, types, seen, rest)
    discounts = [words.discounts]
    store.drop(f"chunks/kind={LISTED}")
    store.release()

    gathered = chunks.union(_of(level, 10 + ANSWER))
    sums = []
    for k in range(2, order + 1):
        # asked in passes over the chunks, more of them the more is known, then answered part by part, so that what was shuffled for the one is gone before the other
        for some in _passes(gathered, k - 1):
            asked = some.groupBy("chunk").applyInArrow(_ask(k, buckets, hot), PARTS)
            asked = store.put(asked.withColumn("part", F.pmod("bucket", F.lit(ASKED_PARTS))), f"asked-{k}", "part", append=True)
            store.release()
        for part in range(ASKED_PARTS):
            by = ["bucket", F.when(F.col("bucket") < 0, F.col("chunk"))]
            own = asked.where(F.col("part") == part).drop("part")
            level = store.put(own.groupBy(*by).applyInArrow(_answer(k, buckets, k == order), PARTS), f"order-{k}", append=True)
            store.drop(f"asked-{k}/part={part}")
        store.release()
        discounts.append(Discounts.of(_figures(level, 10 * k + COUNTED).tolist() or [0] * (K + 1)))
        gathered = gathered.union(_of(level, 10 * k + ANSWER))
        sums.append(_summed(level, k))
        store.release()

    for rows in sums:
        gathered = gathered.union(rows)
    out = f"`{id_col}` {id_ddl}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return gathered.groupBy("chunk").applyInArrow(_score(order, buckets, hot, words, discounts, id_col, id_type), out)
