"""Texts within a budget: lines packed one after the other under a budget of tokens, and the newest texts within one of characters."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import single_line

#: Letters of an ASCII word that are a token, what all tokens are worth, the least characters of a cut line, and the sign of a cut.
LETTERS, WORTH, LEAST, CUT = 3.5, 1.12, 8, "…"
_RUN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def units(text: str) -> int:
    """What a text counts before all is multiplied by WORTH; texts with white space between add up."""
    return sum(-int(-len(x) // LETTERS) if x[0].isascii() and (x[0].isalnum() or x[0] == "_") else 1 for x in _RUN.findall(text))


def tokens(count: int) -> int:
    return int(-(-count * WORTH // 1))


def _inner(char: str) -> bool:
    return char.isalnum() or char in ".,'’-"


def shortened(text: str, size: int) -> str:
    """The first `size` characters without the end of a word, a number or an open bracket that they cut."""
    body = text[:size]
    if size < len(text) and body and _inner(text[size]) and _inner(body[-1]):
        words = body.split()
        space = len(body) - len(words[-1]) - 1 if len(words) > 1 or body[:1].isspace() else -1
        if space > len(body) / 2:
            body = body[:space]
        elif text[size].isdigit() or re.search(r"\d[.,]?$", body):
            body = body.rstrip("0123456789.,-")
    opened = max(body.rfind("["), body.rfind("("))
    if opened >= 0 and opened > max(body.rfind("]"), body.rfind(")")):
        body = body[:opened]
    return body.rstrip()


def fitted(line: str, room: int) -> str:
    """The line "- ..." if it counts `room` units at most, else as much of it as does, with a sign that it is cut; empty if that is less than LEAST characters."""
    if units(line) <= room:
        return line
    raw = line.removeprefix("- ")
    cost = lambda size: units(f"- {shortened(raw, size)}{CUT}")
    size = bisect.bisect_right(range(len(raw)), room, key=cost) - 1
    body = shortened(raw, size) if size >= 0 else ""
    return f"- {body}{CUT}" if len(body) >= LEAST else ""


_SHOWN = "place long, id string, line string"


def rendered(entries: DataFrame, header: str, budget: int = 800, reserved: int = 0) -> DataFrame:
    """(chat, text, tokens, included): a chat's lines under the header, as many as the budget of tokens holds, in the order of `place`.

    entries: chat, place, id, kind, trend, status, summary. A line that doesn't fit is cut where it does, or left out if too little would be left; shorter ones after it may
    still fit. `reserved` tokens are kept free for what follows. Only active entries with a summary count; developments show their trend. Chats without a line have no row. Each chat's
    entries are read once, in order, with its text as the only state. Null places come first; entries at one place come by id.
    """
    kind, line = entries.schema["chat"].dataType.simpleString(), single_line(F.col("summary"))
    shown = F.concat(F.lit("- "), line, F.when((F.col("kind") == "development") & (F.coalesce("trend", F.lit("")) != ""), F.concat(F.lit(" [trend: "), F.col("trend"), F.lit("]"))).otherwise(""))
    rows = entries.filter(F.col("status") == "active").filter(line != "").select("chat", F.col("place").cast("long").alias("place"), F.col("id").cast("string").alias("id"), shown.alias("line"))
    begun, most = units(header), budget - reserved
    # As many units as the budget is worth.
    room = next((n for n in range(int(most / WORTH) + 2, -1, -1) if tokens(n) <= most), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, out = None, True, []
        text, used, included = [], begun, []

        def told() -> None:
            if included:
                out.append({"chat": own, "text": "\n".join([header, *text]), "tokens": tokens(used), "included": list(included)})

        for batch in batches:
            for chat, id_, said in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if first or chat != own:
                    told()
                    own, first, text, used, included = chat, False, [], begun, []
                shown = fitted(said, room - used)
                if shown:
                    text.append(shown)
                    used += units(shown)
                    included.append(id_)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
        told()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    columns = f"chat {kind}, text string, tokens long, included array<string>"
    schema = to_arrow_schema(entries.sparkSession.createDataFrame([], columns).schema)
    ordered = rows.repartition("chat").sortWithinPartitions("chat", "place", "id")
    return ordered.mapInArrow(run, columns) if begun <= room else entries.sparkSession.createDataFrame([], columns)


def newest_within(texts: DataFrame, budget: int = 12_000, share: int = 7_000, between: int = 1, mark: str = "\n[...]\n") -> DataFrame:
    """(chat, place, text): of each chat the newest texts within a budget of characters, each with its share at most: longer ones keep their start (55 %) and their end around a mark.

    texts: chat, place, text. What a text takes is known from its length, so that sums over the newer ones say what is left: the oldest that has
    any left gets the rest. `between` characters count between texts. Null and blank texts count for nothing. Of equal places that with the greater text is newer.
    """
    own = F.trim(F.coalesce("text", F.lit("")))
    rows = texts.select("chat", "place", own.alias("text")).filter("text <> ''")
    takes = F.least(F.length("text"), F.lit(share)) + between
    newer = Window.partitionBy("chat").orderBy(F.col("place").desc(), F.col("text").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum(takes).over(newer), F.lit(0))
    kept = rows.withColumn("most", F.least(F.lit(share), left).cast("int")).filter("most > 0")
    head = F.floor((F.col("most") - len(mark)) * 55 / 100).cast("int")
    clipped = F.concat(F.substring(F.col("text"), F.lit(1), head), F.lit(mark), F.right(F.col("text"), F.col("most") - len(mark) - head))
    text = F.when(F.length("text") <= F.col("most"), F.col("text")).when(F.col("most") <= len(mark), F.substring(F.col("text"), F.lit(1), F.col("most"))).otherwise(clipped)
    return kept.select("chat", "place", text.alias("text"))
