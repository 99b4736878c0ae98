"""Phrase collocation mining: phrases of two to four words whose parts seldom stand apart.

Texts become shards: the word ids of some megabytes of one language, with a break after each piece. A shard's suffix array is built by
prefix doubling over word ids, to the four words that phrases can have; the intervals of its LCP array are the shard's different n-grams
and their counts, and these are merged over all shards by key.

A phrase is frequent only if its parts are. So the words are merged first, then pairs, triples and quadruples, and each merge goes back to
the shards that have its frequent n-grams: there the rest is cut out before the next. N-grams travel in compressed blocks, one for
each shard and range of hashes; what goes back is bounded by the shard's own words, and nothing is broadcast. Shards lie in tables bucketed by their number, so that they stay where they are and
only n-grams are shuffled. A shard that has a frequent phrase has all its parts with their totals, so that the shard that owns the phrase
scores it and names the phrases that it covers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SHUFFLES_GO, SMALL_BATCHES, UPPER, configured, cut, mix, partitions, raw, remove, scratch, slices, table

MOST_WORDS = 4
#: Bytes of text of a shard.
SHARD_BYTES = 16 << 20
#: Ranges of hashes for each shuffle partition; an n-gram of all shards is in one of them.
RANGES = 2
#: A place is a shard's number and the number of an n-gram in it; a shard's number is its task's and its own.
GRAM_BITS, OWN_BITS, TASK_BITS = 27, 16, 20
GRAMS = (1 << GRAM_BITS) - 1

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TO_WORDS = bytes.maketrans(_BREAKS + b"\t" + UPPER.encode(), b"\n" * len(_BREAKS) + b" " + LOWER.encode())
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")

#: A shard: tables are its words' counts; later, for each n, the totals and the owners of its frequent n-grams.
_SHARD = "shard long, lang string, n long, words binary, tables array<binary>, ids binary"
_SCORED = "id long, size int, phrase string, a long, l long, r long, score long"
#: A shard without phrase columns, or what a shard tells of a phrase, without those of the shard.
_STEP = f"{_SHARD}, {_SCORED}"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in columns.split(", "))])


def _stored(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 3)


def _read(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, byte by byte, each number as the difference to the one before."""
    rows = np.diff(np.stack(columns).astype("<i8"), axis=1, prepend=0)
    return zstandard.compress(rows.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), 1)


def unpacked(block: bytes, columns: int) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(block), np.uint8).reshape(columns, 8, -1)
    return np.cumsum(np.ascontiguousarray(data.transpose(0, 2, 1)).view("<i8")[:, :, 0], axis=1)


class _Shard:
    """Words of one language as they come: ids from 1, with 0 for a break and -1 where a split leaves nothing."""

    class _Ids(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = found = len(self) - 1
            return found

    def __init__(self, lang: str):
        self.lang, self.size, self.ids, self.chunks = lang, 0, self._Ids({b"\n": 0, b"": -1}), []

    def add(self, text: bytes) -> None:
        words = text.translate(_TO_WORDS).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        self.chunks += [ids[ids >= 0], np.zeros(1, np.int32)]
        self.size += len(text)

    def row(self, shard: int) -> pa.RecordBatch:
        words = sorted((w, k) for w, k in self.ids.items() if k > 0)
        number = np.zeros(len(words) + 1, np.uint32)
        number[[k for _, k in words]] = np.arange(1, len(words) + 1)
        ids = number[np.concatenate(self.chunks)]
        counts = np.bincount(ids, minlength=len(words) + 1)[1:].astype("<i8")
        return pa.RecordBatch.from_pylist([{"shard": shard, "lang": self.lang, "n": int(counts.sum()), "words": zstandard.compress(b"\n".join(w for w, _ in words)), "tables": [_stored(counts)], "ids": _stored(ids)}], _schema(_SHARD))


def _words(row: dict) -> list[bytes]:
    data = zstandard.decompress(row["words"])
    return data.split(b"\n") if data else []


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of about `most` bytes, cut at a break."""
    at = 0
    while at < len(text) or not at:
        end = _BREAK.search(text, at + most) if at + most < len(text) else None
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to + 1


def _sharded(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, shards = TaskContext.get().partitionId(), 0, {}

        def row(shard: _Shard) -> pa.RecordBatch:
            nonlocal done
            if task >> TASK_BITS or done >> OWN_BITS:
                raise ValueError("too many shards")
            done += 1
            return shard.row(task << OWN_BITS | done - 1)

        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                for part in _parts(text, shard_bytes):
                    shard = shards.setdefault(lang, _Shard(lang))
                    shard.add(part)
                    if shard.size >= shard_bytes:
                        yield row(shards.pop(lang))
        for shard in shards.values():
            yield row(shard)

    return run


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, run, lcp): places of words sorted by the `depth` words that begin there, of each place the words up to a break, and of each of the sorted how many words it shares with the one before.

    ids: words from 1, 0 for a break, the last one a break; both numbers are `depth` at most. Ranks by h words give ranks by 2h.
    """
    rank, run, reach = ids.astype(np.int64), (ids > 0).astype(np.int8), 1
    order = np.argsort(rank) if depth == 1 else None
    while reach < depth:
        whole = run == reach
        after, more = np.zeros_like(rank), np.zeros_like(run)
        after[:-reach], more[:-reach] = rank[reach:], run[reach:]
        key = rank * (int(rank.max(initial=0)) + 1) + np.where(whole, after, 0)
        run = run + np.where(whole, more, 0).astype(np.int8)
        order = np.argsort(key)
        found = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[False, found[1:] != found[:-1]][: len(found)])
        reach *= 2
    order = order[ids[order] > 0]
    padded, lcp, same = np.r_[ids, np.zeros(depth, ids.dtype)], np.zeros(len(order), np.int8), np.ones(max(len(order) - 1, 0), bool)
    for d in range(depth):
        left, right = padded[order[:-1] + d], padded[order[1:] + d]
        same = same & (left == right) & (left > 0)
        lcp[1:] += same
    return order, np.minimum(run, depth), lcp


class Grams:
    """A shard's different n-grams for each n, in the order of its suffix array."""

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, (self.order, self.run, self.lcp) = ids, suffix_array(ids, depth)

    def numbers(self, n: int) -> np.ndarray:
        """At each place of ids the number of its n-gram, from 1, or 0; a word's is its id."""
        return self.intervals(n)[2] if n > 1 else np.r_[self.ids, np.zeros(MOST_WORDS, self.ids.dtype)].astype(np.int64)

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A place of each n-gram, its count, and at each place of ids the number of its n-gram, from 1, or 0."""
        valid = self.run[self.order] >= n
        heads = valid & (self.lcp < n)
        label = np.cumsum(heads)[valid]
        at = np.zeros(len(self.ids) + MOST_WORDS, np.int64)
        at[self.order[valid]] = label
        return self.order[heads], np.bincount(label, minlength=1)[1:], at


_BLOCKS = "range int, shard long, start long, lang string, words binary, block binary"
_FOUND = "shard long, block binary"


def _dealt(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): n-grams in the order of their ranges, which gives them their numbers, and where each range ends."""
    if len(hashes) > GRAMS:
        raise ValueError("a text without breaks has too many different phrases")
    own = (mix(hashes) >> np.uint64(32)).astype(np.int64) % ranges
    return np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=ranges))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _gram_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first.astype(np.uint64)) + second.astype(np.uint64)


def _blocks(row: dict, hashes: np.ndarray, ranges: int, columns: list[np.ndarray], words: list[bytes] | None = None) -> pa.RecordBatch:
    """A block for each range of which the shard has some; columns: keys but words, and counts."""
    order, ends = _dealt(hashes, ranges)
    out = []
    for k, (at, to) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
        if to > at:
            x = order[at:to]
            said = None if words is None else zstandard.compress(b"\n".join([words[i] for i in x.tolist()]), 1)
            out.append({"range": k, "shard": row["shard"], "start": at, "lang": None if words is None else row["lang"], "words": said, "block": packed(*(c[x] for c in columns))})
    return pa.RecordBatch.from_pylist(out, _schema(_BLOCKS))


def _word_blocks(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = _words(r)
                yield _blocks(r, _word_hashes(words), ranges, [_read(r["tables"][0])], words)

    return run


def _gram_keys(row: dict, grams: Grams, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's n-grams the owners of their two parts of n - 1 words, and the counts."""
    owners, at = _read(row["tables"][-1]), grams.numbers(n - 1)
    heads, counts, _ = grams.intervals(n)
    return owners[at[heads] - 1], owners[at[heads + 1] - 1], counts


def _gram_blocks(n: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first, second, counts = _gram_keys(r, Grams(_read(r["ids"], "<u4"), n), n)
                yield _blocks(r, _gram_hashes(first, second), ranges, [first, second, counts])

    return run


def _merge(least: int):
    """Of all blocks of a range a block for each shard: numbers, totals and owners of what counts `least` in all; the owner is the smallest place that has it."""

    def run(blocks: pa.Table) -> pa.Table:
        keys, places, times = [], [], []
        for r in blocks.to_pylist():
            *key, counts = unpacked(r["block"], 1 if r["lang"] is not None else 3)
            if r["lang"] is not None:
                # No word holds a line break, so that word and language can't be mixed up.
                key = [pc.binary_join_element_wise(pa.array(_words(r), pa.binary()), pa.scalar(r["lang"].encode()), b"\n")]
            keys.append(key)
            places.append((r["shard"] << GRAM_BITS) + r["start"] + np.arange(len(counts)))
            times.append(counts)
        if len(keys[0]) == 1:
            columns = [pa.chunked_array([k[0] for k in keys]).combine_chunks().dictionary_encode().indices.to_numpy()]
        else:
            columns = [np.concatenate([k[j] for k in keys]) for j in (0, 1)]
        del keys
        order = np.lexsort(columns[::-1])
        place, count = np.concatenate(places)[order], np.concatenate(times)[order]
        heads = np.flatnonzero(np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)])
        total, owner, sizes = np.add.reduceat(count, heads), np.minimum.reduceat(place, heads), np.diff(np.r_[heads, len(order)])
        good = np.repeat(total >= least, sizes)
        place, total, owner = place[good], np.repeat(total, sizes)[good], np.repeat(owner, sizes)[good]
        order = np.argsort(place)
        place, total, owner = place[order], total[order], owner[order]
        shards, starts = np.unique(place >> GRAM_BITS, return_index=True)
        parts = zip(*(np.split(x, starts[1:]) for x in (place & GRAMS, total, owner)), strict=True)
        return pa.Table.from_pydict({"shard": shards, "block": [packed(*x) for x, _ in zip(parts, shards, strict=False)]}, _schema(_FOUND))

    return run


def _met(shards: DataFrame, found: DataFrame, step) -> DataFrame:
    """step(row of a shard, numbers, totals, owners of its frequent n-grams) for each shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():  # one
            blocks = [unpacked(x, 3) for x in right.column("block").to_pylist()]
            numbers, totals, owners = np.concatenate([*blocks, np.zeros((3, 0), np.int64)], axis=1)
            order = np.argsort(numbers)
            out += [pa.Table.from_pydict(x, _schema(_STEP)) for x in step(row, numbers[order], totals[order], owners[order])]
        return pa.concat_tables(out) if out else _schema(_STEP).empty_table()

    return shards.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(run, _STEP)


def _runs(good: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ends): the words of stretches in which good n-grams begin at two places in a row or more, and where a break follows among them.

    Stretches that overlap have their common words each.
    """
    edges = np.flatnonzero(np.diff(np.r_[0, good.astype(np.int8), 0]))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    starts, sizes = starts[sizes > 1], sizes[sizes > 1] + n - 1
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum())), ends


def _known_words(ranges: int):
    """The shard with its frequent words alone, numbered in the order of their owners, which is the same in all shards."""

    def step(row: dict, numbers: np.ndarray, totals: np.ndarray, owners: np.ndarray) -> Iterator[dict]:
        words, by = _words(row), np.argsort(owners)
        found = _dealt(_word_hashes(words), ranges)[0][numbers[by]]
        new = np.zeros(len(words) + 1, np.uint32)
        new[found + 1] = np.arange(1, len(by) + 1)
        ids = new[_read(row["ids"], "<u4")]
        places, ends = _runs(ids > 0, 1)
        yield _shard_row(row, zstandard.compress(b"\n".join(words[k] for k in found.tolist())), [totals[by], owners[by]], ids[places], ends)

    return step


def _shard_row(row: dict, words: bytes, tables: list[np.ndarray], ids: np.ndarray, ends: np.ndarray) -> dict:
    own = {"shard": row["shard"], "lang": row["lang"], "n": row["n"], "words": words, "tables": [_stored(x) for x in tables], "ids": _stored(np.insert(ids, ends, 0).astype("<u4"))}
    return {c: [own.get(c)] for c in _schema(_STEP).names}


def _score(a: np.ndarray, both: np.ndarray) -> np.ndarray:
    """floor(2000000 a / both), exactly, also where the product passes 64 bits."""
    if len(a) and int(a.max()) >= 2**63 // 2_000_000:
        return np.array([2_000_000 * x // y for x, y in zip(a.tolist(), both.tolist(), strict=True)], np.int64)
    return 2_000_000 * a // np.maximum(both, 1)


def _step(n: int, last: bool, cover: tuple[int, int], ranges: int):
    """Of frequent n-grams that this shard owns a row with their scores, for each phrase that one of them covers a row without phrase, and the shard with breaks where no n-gram is frequent."""

    def step(row: dict, numbers: np.ndarray, totals: np.ndarray, owners: np.ndarray) -> Iterator[dict]:
        ids, words, tables = _read(row["ids"], "<u4"), _words(row), [_read(x) for x in row["tables"]]
        grams = Grams(ids, n)
        at = {k: grams.numbers(k) for k in range(1, n)}
        heads, _, at[n] = grams.intervals(n)
        sums, owned = ({k: tables[2 * k - 2 + j] for k in range(1, n)} for j in (0, 1))
        sums[n], owned[n] = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        found = _dealt(_gram_hashes(*_gram_keys(row, grams, n)[:2]), ranges)[0][numbers]
        sums[n][found], owned[n][found] = totals, owners

        def count(k: int, places: np.ndarray) -> np.ndarray:
            return sums[k][at[k][places] - 1]

        mine = found[owners == (row["shard"] << GRAM_BITS | numbers)]
        p, a, best = heads[mine], sums[n][mine], None
        for k in range(1, n):
            l, r = count(k, p), count(n - k, p + k)  # noqa: E741
            score = _score(a, l + r)
            better = score < best[2] if best else np.ones(len(p), bool)
            best = tuple(np.where(better, x, y) for x, y in zip((l, r, score), best or (l, r, score), strict=True))
        phrases = [b" ".join([words[i - 1] for i in own]).decode("utf-8", "replace") for own in zip(*(ids[p + d].tolist() for d in range(n)), strict=True)]
        yield _told(row, owned[n][mine], n, phrases, a, *best)
        for m in range(2, n):
            for d in range(n - m + 1):
                covered = p[cover[1] * a >= cover[0] * count(m, p + d)] + d
                yield _told(row, owned[m][at[m][covered] - 1], m)
        if not last:
            places, ends = _runs(sums[n][at[n][: len(ids)] - 1] * (at[n][: len(ids)] > 0) > 0 if len(heads) else np.zeros(len(ids), bool), n)
            new = np.insert(ids[places], ends, 0)
            # Where a word of the new ids stands in the old ones.
            old, cut_grams = np.insert(places, ends, -1), Grams(new, n)
            kept = {1: slice(None)} | {k: at[k][old[cut_grams.intervals(k)[0]]] - 1 for k in range(2, n + 1)}
            yield _shard_row(row, row["words"], [x for k in range(1, n + 1) for x in (sums[k][kept[k]], owned[k][kept[k]])], ids[places], ends)

    return step


def _told(row: dict, ids: np.ndarray, size: int, phrases: list | None = None, *numbers: np.ndarray) -> dict:
    """Rows of phrases; without text and numbers, of covered ones."""
    n = len(ids)
    own = {"shard": [row["shard"]] * n, "lang": [row["lang"]] * n, "id": ids.tolist(), "size": [size] * n, "phrase": phrases} | {c: x.tolist() for c, x in zip(("a", "l", "r", "score"), numbers, strict=False)}
    return {c: [None] * n if own.get(c) is None else own[c] for c in _schema(_STEP).names}


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, cover: tuple[int, int] = (4, 5), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases by score, count and phrase, as the queries' contract defines them.

    Phrases count `least` times or more; one that lies in a longer one whose count is at least cover[0] / cover[1] of its own is left out. Null languages
    are `und`, null texts empty. Rows may repeat and count each time; words may hold anything but spaces, tabs and breaks. A very long text is cut at breaks;
    a piece between two breaks is held whole. Other columns are left out, so that no name clashes; an empty table gives an empty one.
    """
    spark, run = docs.sparkSession, scratch(docs.sparkSession, "collocations")
    name = "collocations_" + run[-32:]

    def kept(df: DataFrame, k: int) -> DataFrame:
        """A table in buckets by shard, so that the next step's n-grams come to the shards."""
        with configured(spark, SMALL_BATCHES | SHUFFLES_GO):
            df.write.bucketBy(partitions(spark), "shard").option("path", f"{run}/{k}").saveAsTable(f"{name}_{k}")
        return spark.table(f"{name}_{k}")

    def done(k: int) -> None:
        spark.sql(f"drop table {name}_{k}")
        remove(spark, f"{run}/{k}")

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    shards, told = kept(texts.mapInArrow(_sharded(shard_bytes), _SHARD), 0), []
    ranges = RANGES * partitions(spark)
    sizes = cut(shards.groupBy("lang").agg(F.sum("n").alias("n")))
    for n in range(1, MOST_WORDS + 1):
        columns, blocks = (["shard", "lang", "words", "tables"], _word_blocks(ranges)) if n == 1 else (["shard", "tables", "ids"], _gram_blocks(n, ranges))
        found = shards.select(columns).mapInArrow(blocks, _BLOCKS).groupBy("range").applyInArrow(_merge(least), _FOUND)
        met = kept(_met(shards, found, _known_words(ranges) if n == 1 else _step(n, n == MOST_WORDS, cover, ranges)), n)
        done(n - 1)
        shards = met.filter("words is not null").select([x.split()[0] for x in _SHARD.split(", ")])
        told.append(cut(met.filter("size is not null").select("lang", *(x.split()[0] for x in _SCORED.split(", ")))))
    done(MOST_WORDS)
    scored = reduce(DataFrame.unionByName, told[1:])
    covered = scored.filter("phrase is null").select("id", "size").distinct()
    left = scored.filter("phrase is not null").join(covered, ["id", "size"], "left_anti")
    # The score that `top` phrases reach, so that no language's phrases have to be sorted in one task.
    own = Window.partitionBy("lang").orderBy(F.desc("score"))
    better = F.coalesce(F.sum("times").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    floor = left.groupBy("lang", "score").agg(F.count("*").alias("times")).select("lang", "score", better.alias("better")).filter(F.col("better") < top).groupBy("lang").agg(F.min("score").alias("floor"))
    best = left.join(floor, "lang").filter("score >= floor")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from d),
total as (select lang, cast(sum(len(ws)) as hugeint) as n from w group by lang),
g as (select lang, k, list_slice(ws, i, i + k - 1) as p, count(*)::hugeint as f from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, range(1, 5) r(k) where len(ws) >= k) group by all having count(*) >= 30),
cuts as (select g.lang, g.p, g.f as a, x.f as l, y.f as r, c, (2000000 * g.f) // (x.f + y.f) as score
  from (select *, unnest(range(1, k)) as c from g where k > 1) g join g x on x.lang = g.lang and x.p = list_slice(g.p, 1, g.c) join g y on y.lang = g.lang and y.p = list_slice(g.p, g.c + 1, g.k)),
best as (select * from cuts qualify row_number() over (partition by lang, p order by score, c) = 1),
inner_ as (select lang, list_slice(p, i, i + m - 1) as p, f from (select lang, p, f, m, unnest(range(1, k - m + 2)) as i from g, range(2, 4) r(m) where m < k)),
covered as (select distinct g.lang, g.p from g join inner_ i on i.lang = g.lang and i.p = g.p where 100 * i.f >= 80 * g.f),
kept as (select b.*, array_to_string(b.p, ' ') as phrase from best b anti join covered c on c.lang = b.lang and c.p = b.p),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join total using (lang) where rank <= 2000
"""
