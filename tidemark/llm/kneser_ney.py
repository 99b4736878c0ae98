"""LM scoring: an interpolated modified Kneser-Ney n-gram model.

Words: tasks turn their tokens into 64-bit hashes and count them; a shuffle by ranges of the hash merges the counts into a table in the
shared folder and numbers the words, frequent ones first. Numbers of frequent words are small, so that n-grams of them pack well.

Counting: tasks count n-grams of such numbers some million tokens at a time, so that what is shuffled are blocks of counted n-grams, one
for each range of the n-gram's hash, not tokens. The task of a range merges the blocks of one narrow range after another, and appends
them to arrays in the shared folder that are sorted by hash. What it learns of the next lower order goes on to a shuffle by ranges of
those n-grams' hashes: the number of different words before an n-gram (its count there), and of its followers the sum and how many have
counts 1, 2 and more. So each order is one shuffle, down to words. A text's start is a word that nothing precedes: n-grams that begin
there keep their plain count. Discounts come from sums over the ranges.

Scoring: workers map the arrays into memory and look up a million tokens at a time with binary search; an n-gram's own row holds both
its count and the sums of its followers, so each order costs one search. Rows of the same numbers share them: a row has one byte that
says which, and the few rows of rare numbers are listed apart. Of the sorted hashes 48 bits are kept, and where each value of the other 16
begins.

Ranges are cut fine enough that one holds the n-grams of some megabytes of text, whatever the corpus. The n-grams of a frequent
context lie in all ranges alike, and in the next order it is one row of sums from each, so no range outgrows the others.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SHUFFLES_GO, SPACE, Memo, configured, crc_mod, mix, partitions, pieces, raw, scratch, slices, table

#: Tokens that a task counts or looks up at a time, and bytes of text whose n-grams a narrow range holds.
CHUNK, RANGE_BYTES = 1_000_000, 16 << 20
#: Hashes of the end and of the place before the first word; no word hash is changed into these.
END, START = 1, 2
#: Numbers of words: of the place before the first, and of words that the model doesn't know; its own are between.
NO_WORD, UNKNOWN = 0, (1 << 32) - 1
#: What a block holds: plain counts of words; counts of n-grams; sums over the followers of n-grams.
WORDS, COUNTS, FOLLOWERS = 0, 1, 2
_ROWS = "part int, sub int, level int, kind int, block binary, n1 long, n2 long, n3 long, n4 long, total long, n long"
#: Arrays of a table: name and type of an element. A count is low + high * 2^32, below 2^40; what doesn't fit fails.
_COUNT = (("key", np.uint64), ("low", np.uint32), ("high", np.uint8))
_SUMS = (("total", np.uint64), ("one", np.uint32), ("two", np.uint32), ("more", np.uint32))
#: Of the words' plain counts: a word's place among those of its part whose counts have as many bits.
_RANK = (("rank", np.uint32),)
#: Of other tables: 32 and 16 bits of the key, and which row of numbers is its own.
_CODED = (("key", np.uint32), ("rest", np.uint16), ("code", np.uint8))
#: The code of rows that are listed apart; lower ones are places of shared rows.
_APART = 255
_BREAK = np.isin(np.arange(256), list(SPACE))


def words_of(text: bytes) -> list[bytes]:
    """Words of `[^\\x20\\x09-\\x0D]+`, with A-Z in lower case."""
    return text.lower().split()


def _hashes() -> Memo:
    """Of words over LONGEST, which it doesn't keep."""
    return Memo(lambda w: max(3, xxhash.xxh64_intdigest(w)))


def extended(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of an n-gram with one more word."""
    with np.errstate(over="ignore"):
        return mix(key * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93))


def key_of(words: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = mix(words[0] + np.uint64(0x9E3779B97F4A7C15))
    for word in words[1:]:
        key = extended(key, word)
    return key


def _word_hashes(text: bytes, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(where each word of a text begins, its hash), eight bytes of all words at a time; memo has the hashes of words over LONGEST."""
    data = b" " + text.lower() + b" " * 9
    ends = np.diff(_BREAK[np.frombuffer(data, np.uint8)].view(np.int8))
    starts, ends = np.flatnonzero(ends == -1) + 1, np.flatnonzero(ends == 1) + 1
    sizes = ends - starts
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    hashes, own, at = mix(sizes.astype(np.uint64)), np.flatnonzero(sizes <= memo.LONGEST), 0
    while len(own):
        some = np.minimum(sizes[own] - at, 8).astype(np.uint64)
        hashes[own] = extended(hashes[own], eight[starts[own] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - some * np.uint64(8))))
        at += 8
        own = own[sizes[own] > at]
    for i in np.flatnonzero(sizes > memo.LONGEST).tolist():
        hashes[i] = memo[data[starts[i] : ends[i]]]
    return starts - 1, np.maximum(hashes, np.uint64(3))


def sequence_of(texts: list[bytes], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of all texts, one after the other: START at place 0, the words, END. Long texts are split piece by piece."""
    hashes, owners, held, of, size = [], [], [], [], 0

    def flush() -> None:
        starts, own = _word_hashes(b" ".join(held), memo)
        hashes.append(own)
        begin = np.cumsum([0, *(len(x) + 1 for x in held[:-1])])
        owners.append(np.array(of, np.int64)[np.searchsorted(begin, starts, "right") - 1])

    for i, text in enumerate(texts):
        for piece in pieces(text):
            held.append(piece)
            of.append(i)
            size += len(piece)
            if size >= 1 << 20:
                flush()
                held, of, size = [], [], 0
    if held:
        flush()
    owner = np.concatenate([np.empty(0, np.int64), *owners])
    sizes = np.bincount(owner, minlength=len(texts)) + 2
    starts = np.cumsum(sizes) - sizes
    seq = np.empty(int(sizes.sum()), np.uint64)
    seq[starts], seq[starts + sizes - 1] = START, END
    seq[np.arange(len(owner)) + 2 * owner + 1] = np.concatenate([np.empty(0, np.uint64), *hashes])
    return seq, np.arange(len(seq), dtype=np.int64) - np.repeat(starts, sizes)


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    """The narrow range of a hash, in the order of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


def packed(words: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Columns of words, best in order, and of values under 2^63: the first as differences, all by the significance of bytes, without those that are zero throughout."""
    columns = [np.ascontiguousarray(x, "<u8") for x in (np.diff(words[0], prepend=np.uint64(0)), *words[1:], *values)]
    widths = [(int(x.max()).bit_length() + 7) // 8 for x in columns]
    body = [x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for x, width in zip(columns, widths, strict=True)]
    return len(words[0]).to_bytes(8, "little") + bytes(widths) + zstandard.compress(b"".join(body), 1)


def unpacked(block: bytes, n_words: int, n_values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, head, at = int.from_bytes(block[:8], "little"), 8 + n_words + n_values, 0
    data, columns = zstandard.decompress(block[head:]), []
    for width in block[8:head]:
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
        columns.append(out.view("<u8").ravel())
        at += width * n
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:n_words]], [x.astype(np.int64) for x in columns[n_words:]]


def _blocks(level: int, kind: int, words: list[np.ndarray], values: list[np.ndarray], keys: np.ndarray, parts: int, subs: int) -> Iterator[tuple]:
    """Rows (part, sub, level, kind, block), one for each narrow range."""
    slots = _slot(keys, parts * subs)
    order = np.argsort(slots.astype(np.uint16) if parts * subs <= 1 << 16 else slots, kind="stable")
    words, values = [x[order] for x in words], [x[order] for x in values]
    own, starts = np.unique(slots[order], return_index=True)
    for slot, a, b in zip(own.tolist(), starts, [*starts[1:], len(slots)], strict=True):
        yield slot // subs, slot % subs, level, kind, packed([x[a:b] for x in words], [x[a:b] for x in values])


def _distinct(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns of the different rows of small numbers, in order; how many rows are so)."""
    bits = base.bit_length()
    if bits * len(columns) > 64:
        _, first, of = np.unique(_code(columns[:-1]), return_index=True, return_inverse=True)
        (heads, last), counts = _distinct([of, columns[-1]], max(base, len(first)))
        return [*(c[first[heads]] for c in columns[:-1]), last], counts
    code = columns[0].astype(np.uint64)
    for column in columns[1:]:
        code = code << np.uint64(bits) | column.astype(np.uint64)
    code.sort()
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    own, found = code[starts], []
    for _ in columns:
        found.append((own & np.uint64((1 << bits) - 1)).astype(np.int64))
        own >>= np.uint64(bits)
    return found[::-1], np.diff(starts, append=len(code))


def _code(words: list[np.ndarray]) -> np.ndarray:
    """Numbers that tell rows apart and are in the order of the rows; the words' are below 2^32."""
    code = words[0].astype(np.uint64)
    for i, word in enumerate(words[1:]):
        if i:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
        code = code << np.uint64(32) | word.astype(np.uint64)
    return code


def _rows(rows: tuple[tuple, ...] | list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.binary()] + [pa.int64()] * 6
    names = [x.split()[0] for x in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*(r + (None,) * (11 - len(r)) for r in rows), strict=True), kinds, strict=True)], names)


def _counted(flush):  # noqa: ANN001, ANN202
    """Texts to blocks: flush has them of sequences of some million tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = _hashes(), [], 0
        for batch in slices(batches, 0, 2 << 20):
            held.append(sequence_of(raw(batch.column(0)), memo))
            n += len(held[-1][0])
            if n >= CHUNK:
                yield from map(_rows, batched(flush(*map(np.concatenate, zip(*held, strict=True))), 64))
                held, n = [], 0
        if held:
            yield from map(_rows, batched(flush(*map(np.concatenate, zip(*held, strict=True))), 64))

    return run


def _count_words(parts: int, subs: int):
    """Texts to blocks: their words, with the ends."""

    def flush(seq: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(seq), CHUNK):
            words, counts = np.unique(seq[at : at + CHUNK][place[at : at + CHUNK] > 0], return_counts=True)
            if len(words):
                yield from _blocks(0, WORDS, [words], [counts], words, parts, subs)

    return _counted(flush)


def _count(order: int, parts: int, subs: int, words: Model | None = None):
    """Texts to blocks: of each token the longest n-gram that ends there, up to `order`. words: numbers the words, else their hashes stand for them."""

    def flush(seq: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(seq), CHUNK):
            lo = max(0, at - order)
            where = place[lo : at + CHUNK]
            known, ids = np.unique(seq[lo : at + CHUNK], return_inverse=True)
            if words:
                numbers = _tables(words).words(known)[1]
                by = np.argsort(numbers)
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by))
                known, ids = numbers[by].astype(np.uint64), rank[ids]
            new = np.arange(len(ids)) >= at - lo
            for k in range(1 if order == 1 else 2, order + 1):
                ends = np.flatnonzero(new & ((where == k - 1) if k < order else (where >= max(1, k - 1))))
                if len(ends):
                    found, counts = _distinct([ids[ends - k + 1 + j] for j in range(k)], len(known))
                    grams = [known[x] for x in found]
                    yield from _blocks(k, COUNTS, grams, [counts], key_of(grams), parts, subs)

    return _counted(flush)


def _merged(keys: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(a place of each key, in the order of keys; sums of the weights there)."""
    order = np.argsort(keys)
    own = keys[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return order[starts], [np.add.reduceat(w[order], starts) for w in weights]


def _local(folder: str) -> str | None:
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    return folder if "://" not in folder else None


class _Writer:
    """Appends to a table's arrays; close() puts them in place at once, so that a task that runs again or twice does no harm."""

    def __init__(self, folder: str, name: str, columns: tuple):
        self.folder, self.name, self.columns, self.own, self.n = folder, name, columns, uuid.uuid4().hex, 0
        self.local = _local(folder)
        if self.local is not None:
            os.makedirs(self.local, exist_ok=True)
            self.out = [open(f"{self.local}/.{self.own}.{c}", "wb") for c, _ in columns]
        else:
            from pyarrow import fs

            self.store, self.at = fs.FileSystem.from_uri(folder)
            self.out = [self.store.open_output_stream(f"{self.at}/{name}.{c}.{self.own}") for c, _ in columns]

    def add(self, *arrays: np.ndarray) -> None:
        self.n += len(arrays[0])
        for out, array, (c, kind) in zip(self.out, arrays, self.columns, strict=True):
            if len(array) and int(array.max()) > np.iinfo(kind).max:
                raise OverflowError(f"{c} of {int(array.max())} doesn't fit its column; counts go up to 2^40, numbers of followers to 2^32")
            out.write(array.astype(kind).tobytes())

    def close(self) -> int:
        for out, (c, _) in zip(self.out, self.columns, strict=True):
            out.close()
            if self.local is not None:
                os.replace(f"{self.local}/.{self.own}.{c}", f"{self.local}/{self.name}.{c}")
            else:
                self.store.move(f"{self.at}/{self.name}.{c}.{self.own}", f"{self.at}/{self.name}.{c}")
        return self.n


class _Table:
    """Appends to a table of keys, in their order, and numbers. Keys lack their first 16 bits: of these it is written, after the first, at which row each begins, and the end. The commonest rows of numbers in what comes first are shared: of these and of rows listed apart the numbers are written, of others a code."""

    def __init__(self, folder: str, name: str, columns: tuple):
        self.out, self.numbers = _Writer(folder, name, _CODED), _Writer(folder, name, columns[1:])
        self.apart, self.begins, self.tops = _Writer(folder, name, (("at", np.uint64),)), _Writer(folder, name, (("begin", np.uint64),)), np.zeros(1 << 16, np.int64)
        self.shared: tuple[np.ndarray, ...] | None = None

    def add(self, keys: np.ndarray, *numbers: np.ndarray) -> None:
        own = [x.astype(np.uint64) for x in numbers]
        like = key_of(own)
        if self.shared is None:
            found, first, counts = np.unique(like, return_index=True, return_counts=True)
            often = np.sort(np.argsort(-counts, kind="stable")[:_APART])
            self.shared = found[often], *(x[first[often]] for x in own)
            self.numbers.add(*self.shared[1:])
        at = np.minimum(np.searchsorted(self.shared[0], like), len(self.shared[0]) - 1)
        same = np.logical_and.reduce([x[at] == y for x, y in zip(self.shared[1:], own, strict=True)])
        apart = np.flatnonzero(~same)
        self.apart.add(apart + self.out.n)
        self.numbers.add(*(x[apart] for x in own))
        self.tops += np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        self.out.add(keys >> np.uint64(16) & np.uint64(0xFFFFFFFF), keys & np.uint64(0xFFFF), np.where(same, at, _APART))

    def close(self) -> tuple[int, int, int, int]:
        """Rows, those that are shared, those listed apart, numbers of where keys begin."""
        tops = np.flatnonzero(self.tops)
        self.begins.add(np.r_[tops[0], 0, np.cumsum(self.tops[tops[0] : tops[-1] + 1])])
        return self.out.close(), self.numbers.close() - self.apart.n, self.apart.close(), self.begins.close()


def _among(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Places of hashes among sorted ones, -1 where there are none."""
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, at, -1)


def _among_cut(begin: np.ndarray, keys: np.ndarray, rest: np.ndarray, own: np.ndarray) -> np.ndarray:
    """As _among(), of a table's keys: binary search by 32 bits between the rows where the first 16 begin and end."""
    top = (own >> np.uint64(48)).astype(np.int64) - int(begin[0])
    there = (top >= 0) & (top < len(begin) - 2)
    top = np.where(there, top, 0)
    at, end = begin[top + 1].astype(np.int64), np.where(there, begin[top + 2].astype(np.int64), 0)
    at = np.minimum(at, end)
    key, last, to = (own >> np.uint64(16)).astype(np.uint32), own.astype(np.uint16), end
    for _ in range(int((end - at).max(initial=0)).bit_length()):
        mid = (at + to) >> 1
        less = (keys[np.minimum(mid, len(keys) - 1)] < key) & (mid < to)
        at, to = np.where(less, mid + 1, at), np.where(less, to, mid)
    while True:
        row = np.minimum(at, len(keys) - 1)
        like = (at < end) & (keys[row] == key)
        low = like & (rest[row] < last)
        if not low.any():
            return np.where(like & (rest[row] == last), at, -1)
        at = at + low


def _split(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return counts & 0xFFFFFFFF, counts >> 32


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[dict]]]:
    """(part, sub, rows) of rows that come sorted by part and sub."""
    at, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["part"], row["sub"]) != at:
                if rows:
                    yield *at, rows
                at, rows = (row["part"], row["sub"]), []
            rows.append(row)
    if rows:
        yield *at, rows


def _vocabulary(folder: str):
    """Merges the words' plain counts and writes their table. Gives for each part and number of bits of a count (sub) how many words have it (n), and their counts' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, sums = None, None, np.zeros((2, 64), np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield _rows([(part, bits, 0, None, None, 0, 0, 0, 0, int(total), int(n)) for bits, (total, n) in enumerate(sums.T) if n])

        for own, _, rows in _groups(batches):
            if own != part:
                yield from close()
                part, out, sums = own, _Writer(folder, f"0-{own}", _COUNT + _RANK), np.zeros((2, 64), np.int64)
            each = [unpacked(r["block"], 1, 1) for r in rows]
            keys = np.concatenate([w[0] for w, _ in each])
            at, (count,) = _merged(keys, [np.concatenate([v[0] for _, v in each])])
            bits = np.frexp(count.astype(float))[1]
            order = np.argsort(bits, kind="stable")
            n = np.bincount(bits, minlength=64)
            rank = np.empty(len(bits), np.int64)
            rank[order] = np.arange(len(bits)) - (np.cumsum(n) - n - sums[1])[bits[order]]
            out.add(keys[at], *_split(count), rank)
            sums += np.bincount(bits, count, 64).astype(np.int64), n
        yield from close()

    return run


def _level(folder: str, level: int, order: int, parts: int, subs: int):
    """Merges the n-grams of `level` and writes their table, passes on what belongs to lower levels, and rows of sums (no block).

    Sums have the level, how many n-grams have counts 1 to 4, the sum of counts, and n: how many have 3 and more. With a part, n is the
    number of rows of its table, n1 of those that are shared, n2 of those listed apart, and n3 how many numbers say where keys begin.
    """
    columns = _COUNT + (_SUMS if level < order else ())

    def merge(rows: list[dict], out: _Table) -> Iterator[tuple]:
        counts = [unpacked(r["block"], level, 1) for r in rows if r["kind"] == COUNTS]
        follow = [unpacked(r["block"], level, 4) for r in rows if r["kind"] == FOLLOWERS]
        words = [np.concatenate([w[j] for w, _ in counts + follow]) for j in range(level)]
        n, m = sum(len(v[0]) for _, v in counts), sum(len(v[0]) for _, v in follow)
        sums = [np.concatenate([*(v[0] for _, v in counts), np.zeros(m, np.int64)]), *(np.concatenate([np.zeros(n, np.int64), *(v[i] for _, v in follow)]) for i in range(4))]
        del counts, follow
        keys = key_of(words)
        at, (count, *after) = _merged(keys, sums if level < order else sums[:1])
        out.add(keys[at], *_split(count), *after)
        yield None, None, level, None, None, *(int((count == k).sum()) for k in (1, 2, 3)), int((count == 4).sum()), int(count.sum()), int((count > 2).sum())
        if level > 1:
            own = np.flatnonzero(count)
            count, words = count[own], [w[at[own]] for w in words]
            first, (before,) = _merged(_code(words[1:]), [np.ones(len(count), np.int64)])
            lower = [w[first] for w in words[1:]]
            yield from _blocks(level - 1, COUNTS, lower, [before], key_of(lower), parts, subs)
            first, totals = _merged(_code(words[:-1]), [count, *((count == k).astype(np.int64) for k in (1, 2)), (count > 2).astype(np.int64)])
            lower = [w[first] for w in words[:-1]]
            yield from _blocks(level - 1, FOLLOWERS, lower, totals, key_of(lower), parts, subs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = None, None

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                n, *more = out.close()
                yield _rows([(part, None, level, None, None, *more, 0, 0, n)])

        for own, _, rows in _groups(batches):
            if own != part:
                yield from close()
                part, out = own, None
            if lower := [r for r in rows if r["level"] < level]:
                yield _rows([tuple(r.values()) for r in lower])
            if mine := [r for r in rows if r["level"] == level]:
                out = out or _Table(folder, f"{level}-{part}", columns)
                yield from map(_rows, batched(merge(mine, out), 64))
        yield from close()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and 3 or more, by the numbers of entries with counts 1 to 4; within (0, count)."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw_ = (1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw_, (1, 2, 3), strict=True))


@dataclass(frozen=True)
class Model:
    """folder: of the arrays. sizes: the number of rows of each table's part, by (level, part); level 0 has the words' plain counts.

    first: by part and number of bits of a word's count, the number of the first such word. apart: by (level, part), how many rows of
    numbers are shared, how many listed apart, and how many numbers say where keys begin.
    """

    folder: str
    order: int
    parts: int
    slots: int
    vocabulary: int
    tokens: int
    sizes: dict[tuple[int, int], int] = field(hash=False)
    first: np.ndarray = field(compare=False)
    #: By level, from 1.
    discounts: tuple[tuple[float, float, float], ...] = ()
    #: Sum of the counts of words in level 1, and what discounts take from it.
    lowest: tuple[int, float] = (0, 0.0)
    apart: dict[tuple[int, int], tuple[int, int, int]] = field(hash=False, default_factory=dict)


def count(texts: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """The model of all rows of texts; null and empty texts are an end alone, repeated rows count each time. Its arrays are in the shared folder.

    A very long text is counted some million tokens at a time. Other columns are left out, so that no name clashes; an empty table gives a
    model without words.
    """
    spark, parts = texts.sparkSession, partitions(texts.sparkSession)
    folder, size = scratch(spark, "kneser-ney"), texts.select(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    subs = max(1, -(-size // (parts * RANGE_BYTES)))
    with configured(spark, SHUFFLES_GO):
        words = _numbered(texts.select(text_col), folder, order, parts, subs)
        rows = texts.select(text_col).mapInArrow(_count(order, parts, subs, words), _ROWS)
        for level in range(order, 0, -1):
            rows = _dealt(rows, parts).mapInArrow(_passed(_level(folder, level, order, parts, subs)), _ROWS)
        # A row for each part of a table, and one of sums for each level.
        sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("n1", "n2", "n3", "n4", "total", "n")]
        found = rows.groupBy("level", "part").agg(*sums).collect()
    sizes = words.sizes | {(r.level, r.part): r.n for r in found if r.part is not None}
    apart = {(r.level, r.part): (r.n1, r.n2, r.n3) for r in found if r.part is not None}
    of = {r.level: r for r in found if r.part is None}
    known = tuple(discounts(*of[k][2:6]) if k in of else (0.5, 1.0, 1.5) for k in range(1, order + 1))
    lowest = (of[1].total, float(np.dot(known[0], (of[1].n1, of[1].n2, of[1].n)))) if 1 in of else (0, 0.0)
    return replace(words, discounts=known, lowest=lowest, sizes=sizes, apart=apart)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartitionById(parts, F.coalesce("part", F.lit(0))).sortWithinPartitions("part", "sub")


def _numbered(texts: DataFrame, folder: str, order: int, parts: int, subs: int) -> Model:
    """The model as far as its words: their table is written, and their numbers go from the most bits of a count to the fewest, part by part."""
    found = _dealt(texts.mapInArrow(_count_words(parts, subs), _ROWS), parts).mapInArrow(_vocabulary(folder), _ROWS).select("part", "sub", "total", "n").collect()
    n = np.zeros((64, parts), np.int64)
    for r in found:
        n[63 - r.sub, r.part] = r.n
    if n.sum() >= UNKNOWN - 1:
        raise OverflowError(f"{n.sum()} different words; numbers of words have 32 bits")
    first = (NO_WORD + 1 + np.cumsum(n) - n.ravel()).reshape(n.shape)[::-1].T
    sizes = {(0, p): int(x) for p, x in enumerate(n.sum(axis=0)) if x}
    return Model(folder, order, parts, parts * subs, int(n.sum()), sum(r.total for r in found), sizes, first)


def _passed(run):  # noqa: ANN001, ANN202
    """Lets rows of sums through, which need no merging."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[pa.RecordBatch] = []

        def blocks() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                have = batch.column(4).is_valid()
                sums.append(batch.filter(pc.invert(have)))
                yield batch.filter(have)

        for out in run(blocks()):
            yield from sums
            sums.clear()
            yield out
        yield from sums

    return through


class _Tables:
    """The model's arrays, mapped one by one when first needed."""

    def __init__(self, model: Model):
        self.model, self.open = model, {}

    def array(self, level: int, part: int, column: str, kind: type, n: int | None = None) -> np.ndarray:
        """Fails where a file is missing or has another length than the one written; from a store that can't be mapped it is copied to the worker first."""
        n = self.model.sizes.get((level, part), 0) if n is None else n
        if not n:
            return np.empty(0, kind)
        file = f"{level}-{part}.{column}"
        if (local := _local(self.model.folder)) is not None:
            path = f"{local}/{file}"
        else:
            from pyarrow import fs

            path = f"{tempfile.gettempdir()}/{os.path.basename(self.model.folder)}-{file}"
            if not os.path.exists(path):
                fs.copy_files(f"{self.model.folder}/{file}", f"{path}.{os.getpid()}")
                os.replace(f"{path}.{os.getpid()}", path)
        out = np.memmap(path, kind, "r")
        if len(out) != n:
            raise ValueError(f"{path} has {len(out)} rows, not {n}")
        return out

    def _hits(self, level: int, hashes: np.ndarray, open_: Callable[[int], tuple]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, int]]:
        """(arrays of a part, places there, places of the hashes found there, part)."""
        order = np.argsort(hashes)
        own = hashes[order]
        ranges = _slot(own, self.model.slots) // (self.model.slots // self.model.parts)
        ends = np.searchsorted(ranges, np.arange(self.model.parts + 1))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            if not self.model.sizes.get((level, p)):
                continue
            if (level, p) not in self.open:
                self.open[level, p] = open_(p)
            search, keys, rest = self.open[level, p]
            at = search(*keys, own[ends[p] : ends[p + 1]])
            hit = np.flatnonzero(at >= 0)
            yield rest, at[hit], order[ends[p] + hit], p

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(plain counts, numbers) of words."""
        counts, numbers = np.zeros(len(hashes), np.int64), np.full(len(hashes), UNKNOWN, np.int64)
        numbers[hashes == START] = NO_WORD

        def open_(p: int) -> tuple:
            key, *rest = [self.array(0, p, *c) for c in _COUNT + _RANK]
            return _among, [key], rest

        for (low, high, rank), at, to, p in self._hits(0, hashes, open_):
            counts[to] = low[at].astype(np.int64) + (high[at].astype(np.int64) << 32)
            numbers[to] = self.model.first[p, np.frexp(counts[to].astype(float))[1]] + rank[at]
        return counts, numbers

    def find(self, level: int, hashes: np.ndarray) -> np.ndarray:
        """A column for the counts of hashes and, of levels under the order, one each for the sums of followers; zeros where there are none."""
        columns = _COUNT[1:] + (_SUMS if level < self.model.order else ())

        def open_(p: int) -> tuple:
            shared, apart, begins = self.model.apart[level, p]
            keys, rest, code = [self.array(level, p, *c) for c in _CODED]
            numbers = [self.array(level, p, *c, shared + apart) for c in columns]
            return _among_cut, [self.array(level, p, "begin", np.uint64, begins), keys, rest], [code, self.array(level, p, "at", np.uint64, apart), *numbers]

        out = np.zeros((len(columns) - 1, len(hashes)), np.int64)
        for (code, apart, low, high, *sums), at, to, _ in self._hits(level, hashes, open_):
            row = code[at].astype(np.int64)
            rare = np.flatnonzero(row == _APART)
            row[rare] = len(low) - len(apart) + np.searchsorted(apart, at[rare].astype(np.uint64))
            out[0, to] = low[row].astype(np.int64) + (high[row].astype(np.int64) << 32)
            for i, x in enumerate(sums, 1):
                out[i, to] = x[row]
        return out


@lru_cache(1)
def _tables(model: Model) -> _Tables:
    return _Tables(model)


def _log10(model: Model, seq: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 P, log10 of the base, plain count) of each token of a sequence after what stands before it; at starts the numbers mean nothing."""
    tables = _tables(model)
    known, back = np.unique(seq, return_inverse=True)
    counts, numbers = tables.words(known)
    counts, numbers = counts[back], numbers.astype(np.uint64)
    ids = numbers[back]
    base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))
    total, spare = model.lowest
    p, rows = np.empty(0), np.empty((0, 0))
    for k in range(1, model.order + 1):
        before = rows
        if k == 1:
            rows = tables.find(1, key_of([numbers]))[:, back]
        else:
            # n-grams that would begin before their text's start aren't looked up.
            there = np.flatnonzero((place >= k - 1) & (np.arange(len(seq)) >= k - 1))
            rows = np.zeros((1 if k == model.order else 5, len(seq)), np.int64)
            rows[:, there] = tables.find(k, key_of([ids[there - k + 1 + j] for j in range(k)]))
        d = np.array((0.0, *model.discounts[k - 1]))
        found = np.maximum(rows[0] - d[np.minimum(rows[0], 3)], 0)
        if k == 1:
            p = found / max(1, total) + (spare / total if total else 1.0) / (model.vocabulary + 1)
            continue
        context = before[1:, there - 1]
        some = context[0] > 0
        at, context = there[some], context[:, some]
        p[at] = (found[at] + d[1:] @ context[1:] * p[at]) / context[0]
    return np.log10(p), base, counts


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _hashes()
        for batch in slices(batches, 1, 4 << 20):
            seq, place = sequence_of(raw(batch.column(1)), memo)
            starts = np.flatnonzero(place == 0)
            sums = [np.zeros(len(starts), kind) for kind in (np.int64, np.float64, np.float64)]
            for at in range(0, len(seq), CHUNK):
                lo = max(0, at - model.order)
                to = min(len(seq), at + CHUNK)
                p, base, counts = (x[at - lo :] for x in _log10(model, seq[lo:to], place[lo:to]))
                word = place[at:to] > 0
                of = np.searchsorted(starts, np.arange(at, to), "right") - 1
                for total, x in zip(sums, ((counts > 0) & word, np.where(word, base, 0), np.where(word, p, 0)), strict=True):
                    total += np.bincount(of, x, len(starts)).astype(total.dtype)
            sizes = np.diff(np.r_[starts, len(seq)]) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *map(pa.array, sums)], ["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity) for each row, in log10; every text has its end as a token, also null and empty ones.

    Rows and ids may repeat and be null; equal texts score the same. A very long text is looked up a million tokens at a time. Other
    columns are left out, so that no name clashes; an empty table gives an empty table. Fails if a part of the model is missing.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_score(model), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


#: Of the query, as count() has it; the README has figures of orders 2 and 3.
QUERY_ORDER = 3


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    model = count(docs.filter(~held_out), order=QUERY_ORDER)
    scored = score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
