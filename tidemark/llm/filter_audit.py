"""Filter interaction audit: what each filter of a cascade removes, in every order of the filters.

Every document gets a mask of the filters that it fails, once; all orders follow from the counts of masks. Only the filter on
repeated texts needs other documents: texts are routed by XXH64, the smallest id first, to chains of the different texts that
share a fingerprint, each with its smallest id; what comes later with an equal text fails. Each task sends one record for each of
its texts, whatever the number of its copies, and copies that it can judge itself travel without text, spread by their own id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, cut, described, partitions, table

_UPPER = UPPER.encode()
_MARKS = re.compile(r"[#$%&*|]")
#: A filter: whether a text, given with its words, fails.
Filter = Callable[[str, list[bytes]], bool]


def few_words(text: str, words: list[bytes]) -> bool:
    return len(words) < 100


def repeated_words(text: str, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 80 * len(words)


def much_upper_case(text: str, words: list[bytes]) -> bool:
    raw = text.encode("utf-8", "replace")
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 10 * len(text)


def holds_marks(text: str, words: list[bytes]) -> bool:
    return _MARKS.search(text) is not None


#: The filters on a text alone, by letter; the one on repeated texts comes last.
FILTERS: tuple[tuple[str, Filter], ...] = (("A", few_words), ("B", repeated_words), ("C", much_upper_case), ("D", holds_marks))
REPEATED = "E"
#: Bytes of texts that a task holds to find copies among them; beyond, they are sent and forgotten.
HELD_BYTES = 64 << 20


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _routed(filters: tuple[tuple[str, Filter], ...], held_bytes: int, digest: Callable[[str], int]):
    """Records ((route, judged, id), (id, text, mask, {part: rows})): where other tasks' copies decide, the route is the text's fingerprint, and the text is there."""
    again = 1 << len(filters)

    def judged(id_, mask: int, parts: dict) -> tuple:
        return (xxhash.xxh64_intdigest(repr((id_, mask))), True, 0), (id_, None, mask, parts)

    def sent(held: dict[int, list[list]]) -> Iterator[tuple]:
        for route, chain in held.items():
            for text, id_, mask, parts in chain:
                yield (route, False, id_), (id_, text, mask, dict(parts))

    def run(rows: Iterable) -> Iterator[tuple]:
        held: dict[int, list[list]] = {}
        nameless: dict[int, Counter] = {}
        size = 0
        for id_, text, part in rows:
            text = text or ""
            if id_ is None:
                nameless.setdefault(_mask(filters, text), Counter())[part] += 1
                continue
            chain = held.setdefault(digest(text), [])
            own = next((x for x in chain if x[0] == text), None)
            if own is None:
                chain.append([text, id_, _mask(filters, text), Counter([part])])
                size += len(text)
            elif id_ > own[1]:
                yield judged(id_, own[2] | again, {part: 1})
            elif id_ < own[1]:
                yield judged(own[1], own[2] | again, dict(own[3]))
                own[1], own[3] = id_, Counter([part])
            else:
                own[3][part] += 1
            if size > held_bytes:
                yield from sent(held)
                held, size = {}, 0
        yield from sent(held)
        for mask, parts in nameless.items():
            yield judged(None, mask, dict(parts))

    return run


def _mask(filters: tuple[tuple[str, Filter], ...], text: str) -> int:
    words = text.encode("utf-8", "replace").split()  # at [\x20\x09-\x0D]
    return sum(1 << k for k, (_, fails) in enumerate(filters) if fails(text, words))


def _decided(again: int):
    """(id, part, mask, rows) of records that come by route, and by id from the smallest: of a route the chain of different texts with their smallest ids is held."""

    def run(records: Iterable[tuple]) -> Iterator[tuple]:
        at, chain = None, []
        for (route, _, _), (id_, text, mask, parts) in records:
            if text is not None:
                if route != at:
                    at, chain = route, []
                first = next((x for x in chain if x[0] == text), None)
                if first is None:
                    chain.append((text, id_))
                elif id_ > first[1]:
                    mask |= again
            for part, n in parts.items():
                yield id_, part, mask, n

    return run


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: tuple[tuple[str, Filter], ...] = FILTERS, held_bytes: int = HELD_BYTES, digest: Callable[[str], int] = fingerprint) -> DataFrame:
    """(id, part, mask, n): what n rows of an id and part fail. Bit k of the mask is filter k, the last bit a text that a smaller id has too.

    Null texts are empty, null parts the empty part. Rows of null ids fail no comparison of ids, nor do others by them; rows that repeat an id
    with the same text are counted, and fail only if a still smaller id has the text. A very long text is one record. Other columns
    are left out, so that no name clashes; an empty table gives an empty one. A text that all tasks hold sends a record from each of them.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(part_col).cast("string"), F.lit("")))
    routed = rows.rdd.mapPartitions(_routed(filters, held_bytes, digest))
    sorted_ = routed.repartitionAndSortWithinPartitions(partitions(spark), partitionFunc=lambda key: key[0])
    return spark.createDataFrame(sorted_.mapPartitions(_decided(1 << len(filters))), f"id {kind}, part string, mask int, n long", verifySchema=False)


def _cascades(letters: str):
    """Rows of the report of one part, from its counts of documents, good and toxic ones by mask."""

    def run(item: tuple[str, np.ndarray]) -> Iterator[tuple]:
        part, counts = item[0], [tuple(map(int, x)) for x in item[1]]
        total, found, shapley = sum(x[0] for x in counts), [], Counter()
        for order in permutations(range(len(letters))):
            earlier, kept = 0, total
            for step, k in enumerate(order, 1):
                failing = [m for m in range(len(counts)) if m >> k & 1]
                here = [m for m in failing if not m & earlier]
                removed, good, toxic = (sum(counts[m][j] for m in here) for j in range(3))
                kept -= removed
                shapley[k] += removed
                found.append(("".join(letters[x] for x in order), step, k, kept, removed, sum(counts[m][0] for m in failing) - removed, counts[1 << k][0], good, toxic))
                earlier |= 1 << k
        for order, step, k, *values in found:
            yield part, order, step, *values, shapley[k]

    return run


_REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: tuple[tuple[str, Filter], ...] = FILTERS, repeated: str = REPEATED) -> DataFrame:
    """A row for each part, order of the filters and step: counts of documents kept, removed here, failing here but removed earlier, failing only this
    filter, good and toxic ones removed here, and the filter's removals summed over all orders.

    labels: (doc_id, quality, toxic); a document is good (toxic) if any of its rows says 1, others are neither. Filters are few, as all orders are
    reported; letters are one character each. Odd rows are as in `masks`; an empty table gives an empty report.
    """
    spark, n = docs.sparkSession, 1 << len(filters) + 1
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Kept, so that no text is routed again if an executor is lost later.
    rows = cut(masks(docs, id_col, text_col, part_col, filters).join(known, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, times, good, toxic = row
        counts[mask] += (times, times * good, times * toxic)
        return counts

    vectors = rows.rdd.map(lambda r: (r[0], tuple(r)[1:])).combineByKey(lambda row: add(np.zeros((n, 3), np.int64), row), add, np.add, partitions(spark))
    return spark.createDataFrame(vectors.flatMap(_cascades("".join(x for x, _ in filters) + repeated)), _REPORT, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with described(spark, f"masks of {sf_dir}/documents.parquet with {sf_dir}/labels.parquet"):
        return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, doc_id > min(doc_id) over (partition by t) as again from d),
f as (select doc_id, part, cast(len(ws) < 100 as int) + 2 * cast(100 * len(list_distinct(ws)) < 80 * len(ws) as int)
  + 4 * cast(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) as int)
  + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(again, false) as int) as mask from w),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f left join l using (doc_id) group by all),
x(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from x a, x b, x c, x d, x e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier from o, range(1, 6) r(step)),
c as (select part, filter_order, step, bit, sum(n) filter (mask & (earlier | bit) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & earlier = 0) as removed,
  sum(n) filter (mask & bit > 0 and mask & earlier > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
  sum(good) filter (mask & bit > 0 and mask & earlier = 0) as good_lost, sum(toxic) filter (mask & bit > 0 and mask & earlier = 0) as toxic_lost from s, m group by all)
select part, filter_order, cast(step as int) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
  cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost,
  cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(sum(coalesce(removed, 0)) over (partition by part, bit) as bigint) as shapley from c
"""
