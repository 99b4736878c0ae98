"""Packing: documents into sequences of equal length, by concatenating and cutting.

Texts are tokenised once, and their ids kept with the number of ids before them in their partition. Prefix sums over the totals of
partitions give every partition its place in the stream of all tokens. The second pass cuts each document where the stream comes to a
multiple of the sequence length. Nothing is padded but the last sequence.
A sequence that lies in several partitions is put together from their boundary records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import SMALL_BATCHES, Memo, configured, raw, scratch, slices, table

SEQUENCE_TOKENS = 2048
#: The id after each document.
END = 1


@cache
def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters of Latin-1 are as they are in the normal form, and have one lower case each.
_LETTERS = re.compile(r"[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: A letter, and the marks that end a word.
_LAST = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff][!#$%&()*+,./:;=?@^_~-]+\Z")


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it can be printed, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + rest.index(b) if b in rest else b for b in range(256)}


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    Of the default tokenizer it is known that no token crosses a space, nor goes on after a letter with a mark, and what its pattern makes of
    letters alone: so words can be memoised, and new ones need no more than its merges.
    """

    def __init__(self, path: str):
        self.tokenizer, self.by_word = Tokenizer.from_file(path), path == default_tokenizer()
        self.merge, self.characters = self.tokenizer.model.tokenize, byte_characters()
        self.ids = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.words = Memo(self.word, 300_000)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if word.isalpha() and _LETTERS.fullmatch(word):
            own = word.lower()
            own = own if own.isascii() else own.encode().decode("latin-1").translate(self.characters)
            return b"".join([self.ids[t.id] for t in self.merge(own)])
        if (cut := _LAST.search(word)) is not None:
            return self.words[word[: cut.start() + 1]] + self.words[word[cut.start() + 1 :]]
        return self.whole(word)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" "))) if self.by_word else self.whole(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # which gives back what a batch of long texts took
        own, last, before = encoder(path), np.array([end], "<u4").tobytes(), 0
        try:
            for batch in slices(batches, 1, 1 << 20):
                ids = [own(x.decode("utf-8", "replace")) + last for x in raw(batch.column(1))]
                ends = before + np.cumsum([len(x) // 4 for x in ids])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(np.r_[before, ends[:-1]])], ["id", "ids", "before"])
                before = int(ends[-1])
        finally:  # a worker that waits for another stage's task holds no memo
            own.words.forget()

    return run


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id, ids, before, part): ids as little-endian 32-bit numbers, with `end` after them, the number of ids before them in their partition, and the partition; a written table, so that this holds from now on.

    Null and empty texts have the end alone. Rows and ids may repeat and be null; a very long text is one row. Other columns are left out, so that
    no name clashes; an empty table gives an empty one.
    """
    spark, columns = docs.sparkSession, f"id {docs.schema[id_col].dataType.simpleString()}, ids binary, before long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encoded(path, end), columns)
    at = scratch(spark, "tokens")
    with configured(spark, SMALL_BATCHES):
        rows.withColumn("part", F.spark_partition_id()).write.option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(at)
    return spark.read.schema(f"{columns}, part int").parquet(at)


def _cut_at(size: int, bases) -> Iterator[pa.RecordBatch]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids = batch.column(1)
            ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
            rows, starts, lengths, at, totals = [], [], [], [], []
            for k, (n, before, part) in enumerate(zip((np.diff(ends) // 4).tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                g, done = bases.value[part] + before, 0
                while done < n:
                    length = min(n - done, size - (g + done) % size)
                    rows.append(k)
                    starts.append(done)
                    lengths.append(length)
                    at.append(g + done)
                    totals.append(n)
                    done += length
            # Pieces follow each other, so that the ids stay where they are.
            cuts = np.r_[ends[rows] + 4 * np.array(starts, np.int32), ends[-1:]].astype(np.int32)
            pieces = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), ids.buffers()[2]])
            own, at = batch.column(0).take(pa.array(rows, pa.int64())), np.array(at, np.int64)
            yield pa.RecordBatch.from_arrays(
                [own, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pieces, pa.array(totals, pa.int64()), pa.array(at // size), pa.array(at % size)],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pieces(tokens: DataFrame, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of the rows of `tokenized`, in sequences of `size` tokens; the last may have fewer.

    Of all other documents only sums for each partition are needed, one each. Repeated and null ids are rows of their own; an empty table gives an empty one.
    """
    spark = tokens.sparkSession
    totals = dict(tokens.groupBy("part").agg(F.sum(F.octet_length("ids").cast("long")) / 4).collect())
    bases = np.concatenate([[0], np.cumsum([int(totals.get(k, 0)) for k in range(max(totals, default=-1) + 1)], dtype=np.int64)])
    kind = tokens.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(bases.tolist())
    return tokens.select("id", "ids", "before", "part").mapInArrow(_cut_at(size, shared), f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _joined(size: int):
    """Sequences that are whole in a partition, and what of others it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, n = None, 0, [], 0
        out: list[tuple] = []
        for batch in batches:
            for sequence, offset, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sequence != now or offset != first + n:
                    if held:
                        out.append((now, first, b"".join(held)))
                    now, first, held, n = sequence, offset, [], 0
                held.append(ids)
                n += len(ids) // 4
            if out:
                yield _fragments(out)
                out = []
        if held:
            yield _fragments([(now, first, b"".join(held))])

    return run


def _fragments(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("sequence_id", "offset", "ids"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]))


def sequences(cut_pieces: DataFrame, size: int = SEQUENCE_TOKENS, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, ids as little-endian 32-bit numbers, padded to `size` unless their number is a power of two.

    Where pieces come in the order of the stream, as `pieces` gives them, only the fragments at both ends of partitions are shuffled; any order gives the same. An empty table gives an empty one.
    """
    parts = cut_pieces.select("sequence_id", "offset", "ids").mapInArrow(_joined(size), "sequence_id long, offset long, ids binary")
    whole = F.octet_length("ids") == 4 * size
    split = parts.filter(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    met = split.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    every = parts.filter(whole).select("sequence_id", "ids").unionByName(met).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
    return every.select("sequence_id", "n_tokens", F.concat("ids", _padding(F.col("n_tokens"), size, pad)).alias("ids"))


def _padding(n: Column, size: int, pad: int) -> Column:
    power = n.bitwiseAND(n - 1) == 0
    return F.unhex(F.when(power, F.lit("")).otherwise(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (size - n).cast("int"))))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces(tokenized(table(spark, sf_dir, "documents"), default_tokenizer()))
    return found.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
