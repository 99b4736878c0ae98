"""The ordered message log: roles, fingerprints, lineage chains, exchange windows.

A log has the columns chat (any key), pos (order within it), role and text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import elapsed
from tidemark.functions.text import FNV_PRIME, FNV_SEEDS, hash_text


def fingerprint(role: Column, text: Column, shown: bool = False) -> Column:
    """Hash of a message's JSON form with sorted keys; with `shown` as if it weren't hidden."""
    hidden = F.lit(False) if shown else role == "system"
    whole = F.struct(F.coalesce(text, F.lit("")).alias("content"), hidden.alias("is_system"), (role == "user").alias("is_user"), F.lit("").alias("name"), F.coalesce(role, F.lit("")).alias("role"))
    return hash_text(F.to_json(whole))


def _fnv(text: str) -> str:
    data, out = text.encode("utf-16-le"), ""
    for h in FNV_SEEDS:
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * FNV_PRIME) & 0xFFFFFFFF
        out += f"{h:08x}"
    return out


def lineage(log: DataFrame) -> DataFrame:
    """(chat, pos, fingerprint, lineage_key, parent_key): each row's key hashes the key before it and its own fingerprint.

    The chain is sequential within a chat. Rows are dealt by chat and streamed in order with one key as the only state, so a
    chat of any length takes constant memory. Rows that share a pos come in the order of their fingerprints.
    """
    return _chained(log.select("chat", "pos", fingerprint(F.col("role"), F.col("text")).alias("fingerprint")), "ln_")


def content_lineage(log: DataFrame) -> DataFrame:
    """(chat, pos, content_key): the chain of rows as if none were hidden, so that hiding one changes no key."""
    rows = log.select("chat", "pos", fingerprint(F.col("role"), F.col("text"), shown=True).alias("fingerprint"))
    return _chained(rows, "cl_").select("chat", "pos", F.col("lineage_key").alias("content_key"))


def heads(chained: DataFrame) -> DataFrame:
    """(chat, head): a chat's number of rows and last key. chained: of lineage()."""
    last = F.max_by("lineage_key", F.struct("pos", "fingerprint"))
    return chained.groupBy("chat").agg(F.concat_ws(":", F.count("*"), last).alias("head"))


def _chained(rows: DataFrame, prefix: str) -> DataFrame:
    kind = rows.schema["chat"].dataType.simpleString()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, key, started = None, "root", False
        for batch in batches:
            keys, parents = [], []
            for own, mark in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or own != chat:
                    chat, key, started = own, "root", True
                parents.append(key)
                key = prefix + _fnv(f"{key}|{mark}")
                keys.append(key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string()), pa.array(parents, pa.string())], ["chat", "pos", "fingerprint", "lineage_key", "parent_key"])

    ordered = rows.repartition("chat").sortWithinPartitions("chat", "pos", "fingerprint")
    return ordered.mapInArrow(chain, f"chat {kind}, pos {rows.schema['pos'].dataType.simpleString()}, fingerprint string, lineage_key string, parent_key string")


def divergence(left: DataFrame, right: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(chat, diverges_at): the first pos where two versions of a log differ, -1 if nowhere. One missing row is a difference."""
    both = left.select("chat", "pos", F.col(key).alias("l")).join(right.select("chat", "pos", F.col(key).alias("r")), ["chat", "pos"], "full")
    return both.groupBy("chat").agg(F.coalesce(F.min(F.when(~F.col("l").eqNullSafe(F.col("r")), F.col("pos"))), F.lit(-1)).alias("diverges_at"))


def exchanges(log: DataFrame) -> DataFrame:
    """log with end_pos (which replaces a column of that name), the reply that ends a row's exchange: a reply and what came since the reply before. Rows after the last reply belong to none and go; system rows are no evidence and go too."""
    # From the newest row on, so that a row's frame is the one before it and one more.
    after = Window.partitionBy("chat").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = log.withColumn("end_pos", F.min(F.when(F.col("role") == "assistant", F.col("pos"))).over(after))
    return ended.filter(F.col("end_pos").isNotNull() & (F.col("role") != "system"))


def exchange_windows(log: DataFrame) -> DataFrame:
    """(chat, end_pos, start_pos, n_rows) of each exchange: where it ends and begins, and its rows but system ones."""
    return exchanges(log).groupBy("chat", "end_pos").agg(F.min("pos").alias("start_pos"), F.count("*").alias("n_rows"))


def newest_rows(log: DataFrame, most: int = 4) -> DataFrame:
    """The newest rows of each exchange, with their rank from the newest, which replaces a column of that name."""
    rank = F.row_number().over(Window.partitionBy("chat", "end_pos").orderBy(F.col("pos").desc()))
    return exchanges(log).withColumn("rank", rank).filter(F.col("rank") <= most)


def rebuild_plan(log: DataFrame, most: int = 1024) -> DataFrame:
    """Per chat: exchanges to replay, the first and last of them, visible rows, and whether the number is over the limit."""
    windows = exchange_windows(log)
    return windows.groupBy("chat").agg(F.count("*").alias("n_windows"), F.min("end_pos").alias("first_end"), F.max("end_pos").alias("last_end"), F.sum("n_rows").alias("n_rows"), (F.count("*") > most).alias("over_limit"))


def newest_elapsed(log: DataFrame) -> DataFrame:
    """(chat, raw, amount, unit, meaningful): the last phrase of time narrated as past that is meaningful, else the last one, of each chat's log.

    log: chat, pos, role, text. System rows and rows without a place don't count; null roles do. Of rows at one place the phrase that sorts last
    counts. Chats without a phrase have no row.
    """
    told = log.filter("pos is not null and coalesce(role, '') <> 'system'").select("chat", "pos", F.posexplode(elapsed.established(F.col("text"))).alias("k", "p"))
    newest = told.groupBy("chat").agg(F.max(F.struct(F.col("p.meaningful").alias("m"), "pos", "k", "p")).alias("x"))
    return newest.select("chat", "x.p.*")
