"""SimHash near-dedup.

A fingerprint is cut into 7 segments (of 9 or 10 bits); the segment-popcount embedding maps it to the vector of its
segments' bit counts. The Manhattan distance of two vectors is a lower bound of the Hamming distance of the fingerprints.
Popcounts alone take few values: the grid's cells would hold a part of all fingerprints that doesn't shrink with more data, and
the join would grow with its square. So a second key keeps cells small: two fingerprints within 4 differing bits agree in at
least 3 segments, and rows meet by the bits of each choice of 3 segments. Where many rows share such a key, the popcount grid
splits them: the bit count of the other segments, in steps of 5, puts a row into its own step and the next, as counts within 4
of each other lie at most one step apart. Within a cell rows pass the Manhattan bound over all segments, then the exact test.

Copies meet first: the grid sees each different fingerprint once. A cell yields a spanning forest of its links, not all of
its pairs, and cells that still have too many rows are dealt out over block pairs, so that no task needs a whole one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, partitions, pieces, raw, slices, table

MAX_BITS = 4
#: Lowest bit and width of each segment; 7 segments keep at least 3 untouched by 4 flips.
WIDTHS = (9, 9, 9, 9, 9, 9, 10)
STARTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS[:-1])))
CHOICES = tuple(combinations(range(7), 3))
#: A cell with more rows is dealt out over pairs of blocks of about this size.
CELL_ROWS = 2048


def _long_fingerprint(text: bytes, chunk: int) -> int:
    """Of a very long text: bit counts of its shingles are summed chunk by chunk, with the last three words carried on."""
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for piece in pieces(text, chunk):
        words = carried + piece.lower().split()
        if len(words) >= 4:
            bits, sizes = _bit_counts([words])
            ones, n = ones + bits[0], n + int(sizes[0])
        carried = words[-3:] if len(words) >= 4 else words
    if not n:
        return int(fingerprints([b" ".join(carried)])[0])
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(texts: list[bytes], chunk: int = 1 << 20) -> np.ndarray:
    """uint64 fingerprints over 4-word shingles; no words: zero. Texts longer than chunk bytes are taken in chunks."""
    out = np.zeros(len(texts), np.uint64)
    short = [i for i, text in enumerate(texts) if len(text) <= chunk]
    ones, sizes = _bit_counts([texts[i].lower().split() for i in short])
    out[short] = np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").ravel()
    for i, text in enumerate(texts):
        if len(text) > chunk:
            out[i] = _long_fingerprint(text, chunk)
    return out


def _bit_counts(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(how many shingles have each bit, highest first; number of shingles) of each list of words."""
    starts, hashes, at = [], [], 0
    for words in texts:
        starts.append(at)
        if len(words) > 4:
            joined, ends, e = b" ".join(words), [], -1
            for w in words:
                e += len(w) + 1
                ends.append(e)
            hashes += [xxhash.xxh64_intdigest(joined[s:e], 42) for s, e in zip([0, *(x + 1 for x in ends[:-4])], ends[3:], strict=True)]
            at += len(words) - 3
        elif words:
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words), 42))
            at += 1
    sizes = np.diff([*starts, at]).astype(np.int64)
    ones, some = np.zeros((len(texts), 64), np.int64), sizes > 0
    if some.any():
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[some] = np.add.reduceat(bits, np.array(starts)[some], axis=0, dtype=np.int32)
    return ones, sizes


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, 2 << 20):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(raw(batch.column(1))).view(np.int64))], ["id", "fp"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row, with ids of any type; fp is the fingerprint as a signed long. Null and blank texts: zero. A very long text is taken in chunks of 1 MB."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints (as uint64)."""
    rest, edges = fps, []
    counts = np.stack([np.bitwise_count((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in zip(STARTS, WIDTHS, strict=True)], axis=1).astype(np.int8)
    while len(rest) > 1:
        queue, rest, counts = [(rest[0], counts[0])], rest[1:], counts[1:]
        while queue and len(rest):
            x, e = queue.pop()
            near = np.abs(counts - e).sum(axis=1) <= MAX_BITS  # the lower bound
            near[near] = np.bitwise_count(rest[near] ^ x) <= MAX_BITS
            if near.any():
                edges += [(int(x), int(y)) for y in rest[near]]
                queue += zip(rest[near], counts[near], strict=True)
                rest, counts = rest[~near], counts[~near]
    return edges


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, fp) come sorted by cell and part."""

    def solve(cell: np.ndarray, part: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])])
        sizes = np.diff(np.r_[starts, len(cell)])
        a, b = [], []
        for at in starts[sizes == 2].reshape(-1, 1):
            a.append(at)
        pairs = np.concatenate(a) if a else np.empty(0, np.int64)
        close = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= MAX_BITS
        out = [(fp[pairs][close], fp[pairs + 1][close])]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if edges := forest(fp[at : at + n]):
                b.append(np.array(edges, np.uint64))
        out += [(x[:, 0], x[:, 1]) for x in b]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = solve(rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy().view(np.uint64))
        if len(x):
            x, y = x.view(np.int64), y.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        cell, part = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        change = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))
        if len(change):
            yield from flush(rows.slice(0, int(change[-1]) + 1))
            rows = rows.slice(int(change[-1]) + 1)
        held = rows.combine_chunks().to_batches()
    if held:
        yield from flush(pa.Table.from_batches(held))


def links(fps: DataFrame) -> DataFrame:
    """(a, b) of signed longs, a < b: links that connect just what all links within 4 bits connect. fps: different fingerprints in `fp`."""
    n = partitions(fps.sparkSession)

    def bits(i: int) -> str:
        return f"(shiftrightunsigned(fp, {STARTS[i]}) & {(1 << WIDTHS[i]) - 1})"

    cell = ", ".join(f"shiftleft({c}L, 32) | shiftleft({bits(x)}, 20) | shiftleft({bits(y)}, 10) | {bits(z)}" for c, (x, y, z) in enumerate(CHOICES))
    rows = fps.select("fp", F.explode(F.expr(f"array({cell})")).alias("cell"))
    # Cells of more than CELL_ROWS rows, at most 35 / CELL_ROWS of the fingerprints.
    large = rows.groupBy("cell").count().filter(F.col("count") > CELL_ROWS).select("cell", F.lit(True).alias("split"))
    rest = F.element_at(F.array(*(F.lit(_other_bits(c)) for c in CHOICES)), (F.shiftrightunsigned("cell", 32) + 1).cast("int"))
    step = F.floor(F.bit_count(F.col("fp").bitwiseAND(rest)) / (MAX_BITS + 1)).cast("int")
    steps = F.when(F.col("split"), F.array(step, step + 1)).otherwise(F.array(F.lit(0)))
    grid = rows.join(large, "cell", "left").select("cell", "split", F.explode(steps).alias("step"), "fp")
    # Where a step still has too many rows, with b blocks a row goes to the b pairs of blocks that hold its own.
    full = grid.filter("split").groupBy("cell", "step").count().filter(F.col("count") > CELL_ROWS).select("cell", "step", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other))
    dealt = grid.join(full, ["cell", "step"], "left").select("cell", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)).alias("block"), "step", "fp")
    dealt = dealt.select("cell", (F.col("step").cast("long") * 2**40 + F.col("block")).alias("part"), "fp")
    return dealt.repartition(n, "cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_links, "a long, b long").distinct()


def _other_bits(choice: tuple[int, ...]) -> int:
    """The bits outside a choice of segments, as a signed long."""
    bits = sum(((1 << w) - 1) << s for i, (s, w) in enumerate(zip(STARTS, WIDTHS, strict=True)) if i not in choice)
    return bits - (1 << 64) if bits >> 63 else bits


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes; each is a group with a partial minimum and a join, and
    each round is kept in the shared folder.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Kept, so that the join deals both sides anew and can split the rows of a hub.
        least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        star = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # Small-star: edges now point from the larger node b to the smaller a.
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        edges = cut(star.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id reachable by links of at most 4 bits.

    Ids may be of any type that has an order. Null ids take part; a component of null ids alone has a null component_id. Repeated rows give
    a row each. Blank texts have the fingerprint zero and link like any other; very long ones are taken in chunks. Other columns are left
    out, so that no name clashes. An empty table gives an empty table.
    """
    each = cut(simhash(docs, id_col, text_col))
    by_fp = each.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(by_fp.select("fp")))
    rooted = cut(by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    first = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # kept: the join can split a large component
    return each.join(rooted.join(first, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
