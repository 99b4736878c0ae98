"""Benchmark decontamination: an exact set join of benchmark windows with document text.

A window is 10 consecutive words of an item. Its elements are its shingles, runs of 5 words. For containment the
necessary prefix of a window, with shingles ordered by how rare they are in the corpus, is its rarest shingle alone: a
document that holds the window holds that shingle, at the window's offset. So documents are scanned once for benchmark
shingles, the rarest shingle of each window is joined with what was found, the place gives the only possible start
(length and positional bound), and the words there are compared with the window's.

The scan keeps what passes a bitmap of the benchmark's shingle hashes. It has 64 bits and more for each shingle, up to 16 MB; with
a benchmark beyond some two million shingles more passes, and the join that follows is exact in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, Memo, cut, mix, raw, slices, table

WINDOW, SHINGLE = 10, 5
#: Lower-cases A-Z, keeps 0-9, a-z and all non-ASCII bytes, and turns the rest into spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Least and most bits of the index into the bitmap: 8 KB to 16 MB.
BITS = (16, 27)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, factor = np.full(n, k, np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(k):
            factor = factor * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * i)
            total = total + hashes[i : i + n] * (factor | np.uint64(1))
        return mix(total)


def hashes_of(words: list[bytes], known: Memo) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, window text, its length, place and hash of each of its shingles)."""
    known = Memo(xxhash.xxh64_intdigest)
    for batch in slices(batches, 1):
        out: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            words = words_of(text)
            for at in range(max(1, len(words) - WINDOW + 1) if words else 0):
                own = words[at : at + WINDOW]
                found = shingle_hashes(hashes_of(own, known), k := min(SHINGLE, len(own)))
                out.append((item, b" ".join(own).decode("utf-8", "replace"), len(own), k, found.view(np.int64).tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item", "window", "length", "k", "shingles"])


def _scan(bitmap: np.ndarray, bits: int, sizes: tuple[int, ...]):
    """(row, number of words, hits); a hit has the place and hash of a shingle and the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(xxhash.xxh64_intdigest)
        for batch in slices(batches, 1, 2 << 20):
            counts, hits = [], []
            for text in raw(batch.column(1)):
                words = words_of(text)
                counts.append(len(words))
                own, hashes = [], hashes_of(words, known)
                for k in sizes:
                    h = shingle_hashes(hashes, k)
                    on = np.flatnonzero((bitmap[h >> np.uint64(70 - bits)] >> (h & np.uint64(63))) & np.uint64(1))
                    for at in on.tolist():
                        lo = max(0, at - WINDOW + k)
                        own.append({"at": at, "sh": int(h[at].view(np.int64)), "lo": lo, "around": b" ".join(words[lo : at + WINDOW]).decode("utf-8", "replace")})
                hits.append(own)
            kind = pa.list_(pa.struct([("at", pa.int32()), ("sh", pa.int64()), ("lo", pa.int32()), ("around", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hits, kind)], ["id", "n_words", "hits"])

    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_words, n_hit, items (sorted strings) and spans ((start, length) of each occurrence).

    Null texts have no words. Items without words have no window; items of fewer than 10 words are one window. Repeated
    documents and ids give a row each; repeated items count once. Null item ids are left out of `items`, but their words hit. A very
    long text is scanned whole in one task; what is shuffled are its hits alone. Of a window's shingles that are as rare, the one with
    the smallest hash is taken. Other columns are left out, so that no name clashes; empty documents give an empty table, an empty
    benchmark hits nothing.
    """
    spark = docs.sparkSession
    windows = cut(items.select(F.col(item_col).cast("string"), F.col(item_text_col)).mapInArrow(_windows, "item string, window string, length int, k int, shingles array<long>"))
    shingles = windows.select("window", "length", "k", F.posexplode("shingles").alias("offset", "sh")).distinct()
    sizes = tuple(sorted(r.k for r in shingles.select("k").distinct().collect()))  # five numbers at most
    bits = min(max(BITS[0], (64 * shingles.count()).bit_length()), BITS[1])
    # At most 2^21 words of 64 bits, whatever the benchmark.
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    slots = shingles.groupBy(F.shiftrightunsigned("sh", 70 - bits).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sh & 63 as int))")).alias("bits"))
    found = slots.toArrow()  # 32 MB at most, as arrays
    bitmap[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    scanned = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(bitmap, bits, sizes), f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, hits array<struct<at:int,sh:long,lo:int,around:string>>")
    rows = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    hits = rows.select("row", "n_words", F.explode("hits").alias("hit")).select("row", "n_words", "hit.*")
    seen = hits.groupBy("sh").agg(F.count("*").alias("n"))
    # Windows with a shingle that no document has can't occur.
    rarest = shingles.join(seen, "sh", "left").groupBy("window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sh", "offset")).alias("p")).filter("p.n > 0").select("window", "length", "p.sh", "p.offset")
    start = F.col("at") - F.col("offset")
    there = hits.join(rarest, "sh").withColumn("start", start).filter((F.col("start") >= F.col("lo")) & (F.col("start") + F.col("length") <= F.col("n_words")))
    exact = there.filter(F.concat_ws(" ", F.slice(F.split("around", " "), F.col("start") - F.col("lo") + 1, F.col("length"))) == F.col("window"))
    found = exact.select("row", "window", F.struct("start", "length").alias("span"))
    named = found.select("row", "window").distinct().join(windows.filter("item is not null").select("window", "item").distinct(), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = found.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["end"], s["start"]))).alias("n")))["n"]
    out = rows.select("row", "id", "n_words").join(spans.withColumn("n_hit", covered), "row", "left").join(named, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
lens as (select distinct least(10, len(w)) as l from b where len(w) > 0),
bw as (select distinct item_id, least(10, len(w)) as l, w[i + 1 : i + least(10, len(w))] as win
  from (select item_id, w, unnest(range(0, greatest(1, len(w) - 9))) as i from b where len(w) > 0)),
dw as (select doc_id, i, l, w[i + 1 : i + l] as win from (select doc_id, w, l, unnest(range(0, len(w) - l + 1)) as i from d, lens where len(w) >= l)),
occ as (select dw.doc_id, dw.i, dw.l, bw.item_id from dw join bw on dw.l = bw.l and dw.win = bw.win),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + l)) as p from occ) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, cast(item_id as varchar) as item from occ) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.doc_id = hit.doc_id left join its on d.doc_id = its.doc_id
"""
