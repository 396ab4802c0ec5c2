"""SentencePiece BPE: encoding with seeded merge dropout, and lossless decoding."""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .shingles import mix

SPACE = "▁"
CACHE_UNITS = 1_000_000
GROUP_CHARS = 4 << 20
#: Longer units go through the agenda one by one; the others are merged side by side.
LONG = 200
#: So many units' agendas of so many characters in all step together at most, which bounds their arrays.
TOGETHER, TOGETHER_CHARS = 20_000, 1 << 20
#: Steps of an agenda are told apart up to so many; a unit that is not long has less.
GAPS = 1024
DROPOUT, SEED = 0.1, 1
_NEVER = np.int32(2**31 - 1)
_A, _C = 0x9E3779B97F4A7C15, 0x165667B19E3779F9
_UNIT = re.compile(" +[^ ]*")


def _mix(x: int) -> int:
    """``mix`` of one Python number."""
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


class Growing:
    """An array to which others are added."""

    def __init__(self, dtype: type):
        self.room, self.n = np.zeros(1 << 10, dtype), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.room):
            self.room = np.concatenate([self.all, np.zeros(max(self.n, len(x)), self.room.dtype)])
        self.room[self.n : self.n + len(x)] = x
        self.n += len(x)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)


class PieceModel:
    """The merges of a SentencePiece BPE model with byte fallback and identity normalisation.

    Pieces are kept as they read, with spaces; one space is put before the text.
    A ▁ in the text is no space: like all characters without a piece it is spelt
    in bytes, so that decoding gives it back.  No piece may have a space after
    another character, as then merges never leave a unit, some spaces and what
    follows them; other models are refused.

    The agenda of a unit holds its pairs of neighbours that make a piece, best
    score first, leftmost first among equals.  A pair that is taken is skipped
    for good with the probability ``dropout``, else it is merged and its pairs with
    its new neighbours join.  Each occurrence of a unit has a key of its own, whose
    hashes say how many pairs are merged before the next is skipped.

    What an agenda gives depends on the unit and on the steps that are skipped
    alone, so outcomes are kept by these as nodes: a unit's first is that of no skip,
    and a node's children are those of one skip more, so many steps on.
    """

    def __init__(self, model: str = "piece_bpe_32k.model", dropout: float = 0.0, seed: int = 0):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        n = sp.get_piece_size()
        names = [sp.id_to_piece(k) for k in range(n)]
        own = [k for k in range(n) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        if any(SPACE in names[k].lstrip(SPACE) for k in own):
            raise ValueError("pieces cross units")
        self.bytes = {int(names[k][1:-1], 16): k for k in range(n) if sp.is_byte(k)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        names = [x.replace(SPACE, " ") for x in names]
        self.symbol = {names[k]: k for k in own}
        self.surface = [names[k].encode() for k in range(n)]
        for b, k in self.bytes.items():
            self.surface[k] = bytes([b])
        self.pieces = n
        for char in sorted({c for k in own for c in names[k]}):
            self.symbol.setdefault(char, len(self.symbol) + n)
        self.spelt = {k: x for x, k in self.symbol.items() if k >= n}
        rank = {s: r for r, s in enumerate(sorted({sp.get_score(k) for k in own}, reverse=True))}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k in own:
            for cut in range(1, len(names[k])):
                pair = (self.symbol.get(names[k][:cut]), self.symbol.get(names[k][cut:]))
                if None not in pair:
                    self.merges[pair] = (rank[sp.get_score(k)], k)
        self._ranks, self._merged = (np.asarray([x[k] for x in self.merges.values()], np.int32) for k in (0, 1))
        self._slots(np.asarray([a << 32 | b for a, b in self.merges], np.int64))
        self.seed, self.limit = seed, min(int(dropout * 2.0**64), 2**64 - 1)
        self._gaps = np.asarray([min(int((1 - (1 - dropout) ** k) * 2.0**64), 2**64 - 1) for k in range(1, GAPS + 1)], np.uint64)
        self._clear()
        self._of_char = np.full(0x110000, -1, np.int32)
        for char, k in self.symbol.items():
            if len(char) == 1:
                self._of_char[ord(char)] = k

    def _slots(self, keys: np.ndarray) -> None:
        """An open hash table of the merges, at most a quarter full."""
        bits = (len(keys) * 4).bit_length()
        self._shift, self._mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self._key, self._at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self._key[slot] < 0
            self._key[slot[free]] = keys[todo[free]]
            done = self._key[slot] == keys[todo]
            self._at[slot[done]] = todo[done]
            todo, slot = todo[~done], (slot[~done] + np.uint64(1)) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(_A) >> self._shift

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges, -1 for none."""
        out, todo = np.full(len(left), -1, np.int32), np.flatnonzero((left >= 0) & (right >= 0))
        key = left[todo].astype(np.int64) << 32 | right[todo]
        slot = self._slot(key)
        while len(todo):
            there = self._key[slot]
            hit = there == key
            out[todo[hit]] = self._at[slot[hit]]
            on = np.flatnonzero(~hit & (there >= 0))
            todo, key, slot = todo[on], key[on], (slot[on] + np.uint64(1)) & self._mask
        return out

    @staticmethod
    def units(text: str) -> list[str]:
        """The units of a text, each without the first of its spaces."""
        if not text:
            return []
        parts = text.split(" ")
        return [u[1:] for u in _UNIT.findall(" " + text)] if "" in parts else parts

    def _key_of(self, unit: str, variant: int) -> int:
        return xxhash.xxh3_64_intdigest(unit.encode(), _mix(self.seed * _A + variant))

    def _spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def _clear(self) -> None:
        """Forgets all units and nodes.

        A unit has its characters, after a space.  A node has its unit, its ids, how many
        steps it has after the last skip, its parent and the steps between their skips.
        """
        self._first: dict[str, int] = {}
        self._child: dict[int, int] = {}
        self._code, self._ids = Growing(np.uint32), Growing(np.uint32)
        self._code_start, self._code_size, self._unit, self._start, self._size, self._left, self._parent, self._gap = (Growing(np.int64) for _ in range(8))

    def segment(self, unit: str, variant: int) -> list[int]:
        """The ids of one unit as an occurrence whose key is of the variant and the unit."""
        return self.segment_key(unit, self._key_of(unit, variant))

    def segment_key(self, unit: str, key: int) -> list[int]:
        """The ids of an occurrence of a unit, by an agenda in the order of score and place."""
        chars = " " + unit
        symbol = [self.symbol.get(c, -1) for c in chars]
        before, after = list(range(-1, len(chars) - 1)), list(range(1, len(chars) + 1))
        agenda: list[tuple[int, ...]] = []
        turn, merged = 0, 0

        def offer(i: int) -> None:
            j = after[i]
            if j < len(chars) and (found := self.merges.get((symbol[i], symbol[j]))):
                heapq.heappush(agenda, (found[0], i, j, found[1], symbol[i], symbol[j]))

        for i in range(len(chars)):
            offer(i)
        def gap() -> int:
            """Merges before the next skip."""
            nonlocal turn
            out, more = 0, GAPS
            while more == GAPS:
                more = int(np.searchsorted(self._gaps, np.uint64(_mix(key + turn * _C)), side="right"))
                turn, out = turn + 1, out + more
            return out

        until = gap() if self.limit else len(chars)
        while agenda:
            _, i, j, piece, left, right = heapq.heappop(agenda)
            if symbol[i] != left or symbol[j] != right or after[i] != j:
                continue
            if self.limit and merged == until:
                until, merged = gap(), 0
                continue
            merged += 1
            symbol[i], symbol[j], after[i] = piece, -2, after[j]
            if after[j] < len(chars):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < len(chars):
            out += [symbol[i]] if 0 <= symbol[i] < self.pieces else self._spell(chars[i])
            i = after[i]
        return out

    def segment_all(self, units: list[tuple[int, str]]) -> list[bytes]:
        """``segment`` of many (variant, unit), as little-endian 32-bit bytes."""
        return self._occurrences([u for _, u in units], np.asarray([self._key_of(u, v) for v, u in units], np.uint64))

    def _add(self, unit: np.ndarray, parent: np.ndarray, gap: np.ndarray, depth: int) -> range:
        """Makes nodes of as many skips: agendas of units of one length take steps together."""
        skips = np.zeros((len(unit), depth), np.int64)
        node, own = parent, gap
        for k in range(depth - 1, -1, -1):
            skips[:, k] = own + 1
            node, own = self._parent.all[node], self._gap.all[node]
        skips = np.cumsum(skips, axis=1) - 1
        sizes = self._code_size.all[unit]
        order = np.argsort(sizes, kind="stable")
        count, steps, made = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64), []
        edges = np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist()
        for a, e in zip(edges, [*edges[1:], len(unit)], strict=True):
            size = int(sizes[order[a]])
            most = max(1, min(TOGETHER, TOGETHER_CHARS // size))
            for at in range(a, e, most):
                part = order[at : min(at + most, e)]
                codes = self._code.all[self._code_start.all[unit[part]][:, None] + np.arange(size)]
                ids, count[part], steps[part] = self._segment_rows(codes, skips[part])
                made.append(ids)
        start, n = np.zeros(len(unit), np.int64), self._unit.n
        start[order] = self._ids.n + np.cumsum(count[order]) - count[order]
        self._ids.add(np.concatenate(made))
        for own, x in ((self._unit, unit), (self._start, start), (self._size, count), (self._left, steps - (skips[:, -1] + 1 if depth else 0)), (self._parent, parent), (self._gap, gap)):
            own.add(x)
        return range(n, self._unit.n)

    def _add_units(self, units: list[str]) -> None:
        """Makes units and their nodes of no skip."""
        size, n = np.asarray([len(u) + 1 for u in units], np.int64), self._code_size.n
        self._code_start.add(self._code.n + np.cumsum(size) - size)
        self._code_size.add(size)
        self._code.add(np.frombuffer((" " + " ".join(units)).encode("utf-32-le"), np.uint32))
        none = np.full(len(units), -1)
        self._first.update(zip(units, self._add(np.arange(n, n + len(units)), none, none, 0), strict=True))

    def _nodes(self, units: list[str], keys: np.ndarray) -> np.ndarray:
        """The nodes of occurrences of units by their keys, -1 for long units; nodes are kept in a bounded cache."""
        if self._unit.n > CACHE_UNITS:
            self._clear()
        first = self._first
        new = set(units).difference(first)
        long = dict.fromkeys([u for u in new if len(u) > LONG], -1)
        if len(new) > len(long):
            self._add_units([u for u in new if u not in long] if long else list(new))
        node = np.fromiter(map((first | long if long else first).__getitem__, units), np.int64, len(units))
        live, turn = np.flatnonzero(node >= 0) if self.limit else np.zeros(0, np.int64), 0
        while len(live):
            gap = np.searchsorted(self._gaps, mix(keys[live] + np.uint64(turn * _C & (1 << 64) - 1)), side="right")
            skipped = gap < self._left.all[node[live]]
            live, gap = live[skipped], gap[skipped]
            want, back = np.unique(node[live] * GAPS + gap, return_inverse=True)
            found = np.asarray([self._child.get(w, -1) for w in want.tolist()], np.int64)
            if len(new := want[found < 0]):
                parents = new // GAPS
                added = self._add(self._unit.all[parents], parents, new % GAPS, turn + 1)
                self._child.update(zip(new.tolist(), added, strict=True))
                found[found < 0] = added
            node[live] = found[back]
            turn += 1
        return node

    def _found(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each has) of occurrences of units by their keys."""
        node = self._nodes(units, keys)
        ids, start, size = self._ids.all, self._start.all, self._size.all
        if len(long := np.flatnonzero(node < 0)):
            more = [np.asarray(self.segment_key(units[k], int(keys[k])), np.uint32) for k in long.tolist()]
            sizes = np.asarray([len(x) for x in more])
            node[long] = len(start) + np.arange(len(long))
            start, size = np.concatenate([start, len(ids) + np.cumsum(sizes) - sizes]), np.concatenate([size, sizes])
            ids = np.concatenate([ids, *more])
        own = size[node]
        return ids[_spans(start[node], own)], own

    @staticmethod
    def _cut(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=False)]

    def _occurrences(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """The ids of occurrences of units by their keys."""
        return self._cut(*self._found(units, keys))

    def _segment_equal(self, units: list[str], skips: list[tuple[int, ...]]) -> tuple[list[bytes], np.ndarray]:
        """(ids, number of steps) of units of equal length of which as many given steps are skipped."""
        codes = np.frombuffer("".join([" " + u for u in units]).encode("utf-32-le"), np.uint32).reshape(len(units), len(units[0]) + 1)
        ids, count, steps = self._segment_rows(codes, np.asarray(skips, np.int64).reshape(len(units), -1))
        return self._cut(ids, count), steps

    def _segment_rows(self, codes: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, how many each has, number of steps) of units of equal length of which given steps are skipped: a row a unit, a column a character and one that stands for both ends."""
        n, size = codes.shape
        wide = size + 1
        place = np.arange(n * wide).reshape(n, wide)
        after, before = place + 1, place - 1
        after[:, size] = before[:, 0] = place[:, size]
        symbol = np.full((n, wide), -3, np.int32)
        symbol[:, :size] = self._of_char[codes]
        merge = np.full((n, wide), -1, np.int32)
        merge[:, : size - 1] = self._look(symbol[:, : size - 1].ravel(), symbol[:, 1:size].ravel()).reshape(n, size - 1)
        rank = np.where(merge >= 0, self._ranks[merge], _NEVER)
        alive = np.ones((n, wide), bool)
        alive[:, size] = False
        by_row, lives = rank, alive
        after, before, symbol, merge, rank, alive = (x.reshape(-1) for x in (after, before, symbol, merge, rank, alive))
        rows, steps, step = np.arange(n), np.zeros(n, np.int64), 0
        while True:
            i = rows * wide + by_row[rows].argmin(axis=1)
            more = rank[i] != _NEVER
            rows, i = rows[more], i[more]
            if not len(rows):
                break
            steps[rows] += 1
            if skipped.shape[1]:
                skip = (skipped[rows] == step).any(axis=1)
                rank[i[skip]] = _NEVER
                i = i[~skip]
            j = after[i]
            nxt, prv = after[j], before[i]
            symbol[i], alive[j], rank[j] = self._merged[merge[i]], False, _NEVER
            after[i], before[nxt] = nxt, i
            left, right = np.concatenate([i, prv]), np.concatenate([nxt, i])
            found = self._look(symbol[left], symbol[right])
            merge[left] = found
            rank[left] = np.where(found >= 0, self._ranks[found], _NEVER)
            step += 1
        count, ids = lives.sum(axis=1), symbol[alive]
        odd = np.flatnonzero((ids < 0) | (ids >= self.pieces))
        if len(odd):  # characters that are spelt in bytes
            spelt, back = np.unique(codes[lives[:, :size]][odd], return_inverse=True)
            spelling = [self._spell(chr(c)) for c in spelt.tolist()]
            sizes, own = np.asarray([len(x) for x in spelling]), np.ones(len(ids), np.int64)
            own[odd] = sizes[back]
            row, ids = np.repeat(np.arange(n), count), np.repeat(ids, own)
            count = np.bincount(row, weights=own, minlength=n).astype(np.int64)
            to = _spans((np.cumsum(own) - own)[odd], own[odd])
            ids[to] = np.concatenate(spelling)[_spans((np.cumsum(sizes) - sizes)[back], own[odd])]
        return ids.astype(np.uint32), count, steps

    def _joined(self, parts: list[list[str]], keys: np.ndarray) -> list[bytes]:
        ids, sizes = self._found([u for own in parts for u in own], keys)
        upto, cut = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum([0, *map(len, parts)])
        return self._cut(ids, np.diff(upto[cut]))

    def encode_all(self, texts: list[str], variants: list[int]) -> list[bytes]:
        """The ids of texts as little-endian 32-bit bytes; a unit is split alike throughout a variant."""
        parts = [self.units(t) for t in texts]
        return self._joined(parts, np.asarray([self._key_of(u, v) for v, own in zip(variants, parts, strict=True) for u in own], np.uint64))

    def encode_each(self, texts: list[str], documents: list[int]) -> list[bytes]:
        """The ids of texts as little-endian 32-bit bytes; each occurrence of a unit has a key of its document's number and its place there."""
        parts = [self.units(t) for t in texts]
        sizes = np.asarray([len(own) for own in parts], np.int64)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self._joined(parts, mix(np.repeat(np.asarray(documents, np.uint64), sizes) + place.astype(np.uint64) * np.uint64(_A)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; the first piece's leading space was put there by encoding."""
        return b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:].decode()


def _document(doc_id: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(b"" if doc_id is None else str(doc_id).encode(), seed)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, ids): ids of each whole text as little-endian 32-bit bytes.

    With a dropout the segmentation of each unit depends on the seed, the id and
    the unit's place in the text, and on nothing else: it is the same however rows
    are dealt out.  Without, ids are those of the model itself.
    Null texts count as empty and have no ids; repeated rows get equal ids; other
    columns are ignored.
    """
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(model, dropout, seed)
        for batch in batches:
            for at, ids, _ in _encoded(own, batch, seed):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary())], [id_col, "ids"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """(id, text) of encoded texts; null ids give null."""
    source = encoded.select(id_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(model)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, text string")


def _encoded(own: PieceModel, batch: pa.RecordBatch, seed: int) -> Iterator[tuple[int, list[bytes], list[str]]]:
    """(first row, ids, texts) of groups of a batch's rows.

    Encoding makes no reference cycles, and each search for such would walk the
    cache, so there is none meanwhile.
    """
    names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
    at, searching = 0, gc.isenabled()
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < GROUP_CHARS:
            size += len(texts[end])
            end += 1
        gc.disable()
        try:
            ids = own.encode_each(texts[at:end], [_document(i, seed) for i in names[at:end]])
        finally:
            if searching:
                gc.enable()
        yield at, ids, texts[at:end]
        at = end


def encoded_and_decoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = SEED, model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row a document: its number of pieces, the CRC-32 of its ids, and of the bytes of the text decoded from them; ``lossless`` says if that is the text.

    Null texts count as empty: no pieces, both sums 0, lossless.  Texts of any
    length are taken whole.  Repeated rows, and rows with null ids and equal
    texts, get equal results; an empty table gives no rows; other columns of
    ``docs`` are ignored, whatever their names.
    """
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(model, dropout, seed)
        for batch in batches:
            for at, ids, texts in _encoded(own, batch, seed):
                back = [own.decode(x) for x in ids]
                columns = [[len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], [zlib.crc32(t.encode()) for t in back]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), *(pa.array(c, pa.int64()) for c in columns), pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())], [id_col, "n_pieces", "ids_crc32", "text_crc32", "lossless"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_pieces long, ids_crc32 long, text_crc32 long, lossless boolean")
