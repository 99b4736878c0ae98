"""Line dedup: lines that many documents share stay in one of them.

Hashes of the lines' keys are range-partitioned together with the document id, so that one very common line is dealt
over many tasks; each task streams its sorted rows once and decides every run of equal hashes that begins within it. A run
that began before is settled by summing over tasks; its rows aren't held. The result is a compressed bitmap for each
document that loses lines; texts move only where a caller applies the bitmaps.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut, partitions, raw, slices, table

_KEYS = "id long, mark long, hi long, lo long, n_lines int, lines array<int>"
_RUNS = _KEYS + ", edge boolean, fresh long"
_KEY_ROWS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.list_(pa.int32()))])
_RUN_ROWS = pa.schema([*_KEY_ROWS, pa.field("edge", pa.bool_()), pa.field("fresh", pa.int64())])


def line_keys(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _keys_of(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            ids, marks, counts, digests, places, ends = [], [], [], [], [], [0]
            for id_, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                found: dict[bytes, list[int]] = {}
                lines = text.split(b"\n")
                for at, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_keys(line)) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.setdefault(key, []).append(at)
                for key, at in found.items():
                    ids.append(id_)
                    marks.append(mark)
                    counts.append(len(lines))
                    digests.append(xxhash.xxh3_128_digest(key))
                    places += at
                    ends.append(len(places))
            if ids:
                pair = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(counts, pa.int32()), lists], schema=_KEY_ROWS)

    return run


#: Rows of a run that are held until it has enough documents; beyond, they are passed on undecided.
HELD_ROWS = 10_000
#: Runs at the ends of tasks that are sent to all tasks, at most.
BROADCAST_ROWS = 100_000


class _Run:
    """The run of equal hashes that is open while a task's sorted rows stream by: its counts, and few of its rows.

    A run that begins in this task has its largest id here, so that it is decided as soon as it has min_docs documents. The first run of
    a task may go on from the task before: its rows are passed on undecided (edge), with a mark at each new document (fresh), as they come.
    """

    def __init__(self, key: tuple[int, int], begun: bool, min_docs: int):
        self.key, self.begun, self.min_docs = key, begun, min_docs
        self.top = self.last = self.mark = None
        self.docs, self.decided, self.spilled, self.held = 0, False, False, []

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        ids, marks = rows.column("id").to_numpy(), rows.column("mark").to_numpy()
        fresh = np.r_[self.last is None or ids[0] != self.last, ids[1:] != ids[:-1]]
        # Rows that repeat exactly stand side by side.
        other = fresh | np.r_[self.mark is None or marks[0] != self.mark, marks[1:] != marks[:-1]]
        self.top = ids[0] if self.top is None else self.top
        self.last, self.mark = ids[-1], marks[-1]
        self.docs += int(fresh.sum())
        if self.begun:
            yield _marked(rows.filter(pa.array(other)), True, fresh[other])
            return
        rest = rows.filter(pa.array(other & (ids != self.top)))
        if not self.decided and self.docs < self.min_docs:
            self.held.append(rest)
            if sum(map(len, self.held)) > HELD_ROWS:
                self.spilled = True
                yield from self._release(True)
            return
        self.decided = True
        yield from self._release(False)
        yield _marked(rest, False)

    def _release(self, edge: bool) -> Iterator[pa.Table]:
        yield from (_marked(x, edge) for x in self.held)
        self.held = []

    def close(self, last: bool) -> Iterator[pa.Table]:
        """What is still to be told of a run: of the last one of a task, which the next task may go on with, its documents so far."""
        if self.begun or not (last or self.spilled):
            return
        yield from self._release(True)
        hi, lo = self.key
        yield pa.Table.from_pydict({"id": [int(self.top)], "mark": [0], "hi": [hi], "lo": [lo], "n_lines": [0], "lines": [[]], "edge": [True], "fresh": [self.docs]}, schema=_RUN_ROWS)


def _marked(rows: pa.Table, edge: bool, fresh: np.ndarray | None = None) -> pa.Table:
    n = len(rows)
    return pa.Table.from_arrays([*rows.columns, pa.array(np.full(n, edge)), pa.array(np.zeros(n, np.int64) if fresh is None else fresh.astype(np.int64))], schema=_RUN_ROWS)


def _inner(rows: pa.Table, starts: np.ndarray, min_docs: int) -> pa.Table | None:
    """Of whole runs, which begin at starts: the rows that lose their lines."""
    hi, lo, ids, marks = (rows.column(c).to_numpy() for c in ("hi", "lo", "id", "mark"))
    sizes = np.diff(np.r_[starts, len(ids)])
    if not (sizes >= min_docs).any():
        return None
    same = np.r_[False, (ids[1:] == ids[:-1]) & (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])]
    docs = np.add.reduceat((~same).astype(np.int64), starts)
    drop = np.repeat(docs >= min_docs, sizes) & (ids != np.repeat(ids[starts], sizes)) & ~(same & np.r_[False, marks[1:] == marks[:-1]])
    return _marked(rows.filter(pa.array(drop)), False) if drop.any() else None


def _stream_runs(min_docs: int):
    """Rows come sorted by hash, and by id from the largest. Passes on what is to lose its lines, and the runs at both ends."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        run = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            hi, lo = rows.column("hi").to_numpy(), rows.column("lo").to_numpy()
            starts = np.r_[0, np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1]
            first, last = int(starts[1]) if len(starts) > 1 else len(hi), int(starts[-1])
            if run is None or run.key != (int(hi[0]), int(lo[0])):
                if run is not None:
                    yield from run.close(False)
                run = _Run((int(hi[0]), int(lo[0])), run is None, min_docs)
            yield from run.add(rows.slice(0, first))
            if last:
                yield from run.close(False)
                if last > first and (out := _inner(rows.slice(first, last - first), starts[1:-1] - first, min_docs)) is not None:
                    yield out
                run = _Run((int(hi[last]), int(lo[last])), False, min_docs)
                yield from run.add(rows.slice(last))
        if run is not None:
            yield from run.close(True)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in tables(batches):
            if len(rows):
                yield from rows.combine_chunks().to_batches()

    return stream


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """A row (id, mark, n_lines, n_dropped, keep) for each document that loses lines; documents without one keep all.

    mark is XXH64 of the text: rows that repeat an id with other texts have bitmaps of their own. keep is the zlib form of
    the bits of all lines, the first line in the highest bit of the first byte, 1 for a line that stays. A key of at
    least min_chars code points in at least min_docs documents stays only in the largest id that holds it (in all its
    lines there). Ids are integers (others become null); null ids count as the smallest id, -2^63; null and empty texts are one empty
    line. Rows that repeat exactly share a bitmap and count as one document. A very long text is split into lines in one task; no text
    is shuffled. Other columns are left out, so that no name clashes; empty tables give an empty table.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    some = docs.select(F.coalesce(F.col(id_col).try_cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    keys = some.mapInArrow(_keys_of(min_chars), _KEYS)
    dealt = keys.repartitionByRange(n, "hi", "lo", F.col("id").desc()).sortWithinPartitions("hi", "lo", F.col("id").desc(), "mark")
    runs = cut(dealt.mapInArrow(_stream_runs(min_docs), _RUNS))
    # Runs at a task's ends, and those of which more than HELD_ROWS rows were passed on.
    ends = cut(runs.filter("edge").groupBy("hi", "lo").agg(F.sum("fresh").alias("n_docs"), F.max("id").alias("last")).filter(F.col("n_docs") >= min_docs))
    # Mostly two rows a task, which go to the rows of a common line where those are; more of them meet by an exchange whose large parts can be split.
    few = ends.count() <= BROADCAST_ROWS
    late = runs.filter("edge and n_lines > 0").join(F.broadcast(ends) if few else ends, ["hi", "lo"]).filter("id != last")
    drops = runs.filter("not edge").select("id", "mark", "n_lines", "lines").unionByName(late.select("id", "mark", "n_lines", "lines"))
    # A row for each key that a document loses.
    each = drops.groupBy("id", "mark").agg(F.first("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))
    return each.mapInArrow(_pack, "id long, mark long, n_lines int, n_dropped int, keep binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keeps, counts = batch.column(2).to_pylist(), [], []
        for n, lines in zip(sizes, batch.column(3).to_pylist(), strict=True):
            bits = np.ones(n, np.uint8)
            bits[lines] = 0
            keeps.append(zlib.compress(np.packbits(bits).tobytes()))
            counts.append(len(lines))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int32()), pa.array(keeps, pa.binary())], ["id", "mark", "n_lines", "n_dropped", "keep"])


def _kept(texts: pd.Series, keeps: pd.Series) -> pd.Series:
    def one(text: str, bits: bytes) -> str:
        lines = text.split("\n")
        on = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=len(lines))
        return "\n".join(x for x, k in zip(lines, on, strict=True) if k)

    return pd.Series([one(t, k) for t, k in zip(texts, keeps, strict=True)], dtype=object)


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "kept_text") -> DataFrame:
    """docs with the columns n_lines, n_dropped and `out`, which replace columns of these names. Null texts are empty.

    Rows that repeat get the same bitmap; ids that aren't integers count as null. Empty tables give an empty table.
    """
    # One struct for the time of the join, so that no name clashes.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).try_cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"))
    both = keyed.join(bitmaps.select("id", "mark", "n_dropped", "keep"), ["id", "mark"], "left")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in {out, "n_lines", "n_dropped"} or c in {id_col, text_col} - {out}]
    n_lines = F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines")
    # Only documents that lose lines pass through Python.
    changed = both.filter("keep is not null").select(*columns, n_lines, F.col("n_dropped").cast("long").alias("n_dropped"), F.pandas_udf(_kept, "string")(text, F.col("keep")).alias(out))
    same = both.filter("keep is null").select(*columns, n_lines, F.lit(0).cast("long").alias("n_dropped"), text.alias(out))
    return changed.unionByName(same)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_keep_bitmaps(docs, line_keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lines as (
  select doc_id, i, line, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(text, E'\n')) as line, generate_subscripts(string_split(text, E'\n'), 1) as i from docs)
),
common as (select k, max(doc_id) as last from lines where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select l.*, c.k is not null and l.doc_id <> c.last as gone from lines l left join common c on l.k = c.k)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, E'\n' order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
