"""Byte-level BPE encoding and decoding.

A piece's bytes are mapped to Latin-1 text, one character a byte, and an Aho-Corasick automaton over the vocabulary gives
the longest token at every place. Encoding takes the longest token, and backtracks to shorter ones where a token can't
follow its neighbour. Whether it can is a property of the two tokens: unwinding their last merges across the border must
meet no pair that would have merged earlier. That is memoised, and every place is given up at most once, so the time is
linear in the piece, and the result is that of merging pairs by rank.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, raw, slices, table


#: White space that may stand beside a space, where words can't be matched by themselves.
_OTHER = re.compile(r"[^\S \n]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging by rank, of ranks under `below`; used for the vocabulary's own tokens."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Vocabulary:
    """ranks: bytes of each token to its id, which is also the order of merges. Of the tokenizer's own pattern it is known that words can be matched by themselves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.by_word = ranks, regex.compile(pattern), pattern == default_tokenizer()[1]
        self.token = {i: t for t, i in ranks.items()}
        #: The two tokens whose merge makes a token; single bytes have none.
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.size = [0] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.size[rank] = len(piece)
        self.trie = ahocorasick.Automaton()
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(piece) > 1:
                parts = merge_by_rank(piece, ranks, rank)
                if len(parts) != 2:  # no merge ever makes this one; only a whole piece can be it
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                self.joined[self.halves[rank]] = rank
            self.trie.add_word(piece.decode("latin-1"), rank)
        self.trie.make_automaton()
        self.shorter = Memo(self._prefix, len(ranks) + 1)
        self.compatible = Memo(self._compatible, 400_000)
        self.pieces = Memo(self.encode_piece, 300_000)
        self.words = Memo(lambda word: self.encode_word(" " + word), 300_000)

    def _compatible(self, pair: int) -> bool:
        """Whether the two tokens can stand side by side: no merge across their border comes before those that made them."""
        left, right = pair >> 32, pair & 0xFFFFFFFF
        limit = 1 << 62
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            # Undo the later of the two last merges; on the left its right part meets the border, on the right its left part.
            a, b = self.halves.get(left), self.halves.get(right)
            if a and (left > right or not b):
                if left > limit:
                    return True
                limit, left = left, a[1]
            elif b:
                limit, right = right + 1, b[0]
            else:
                return True

    def _prefix(self, rank: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        piece = self.token[rank]
        return next((r for n in range(len(piece) - 1, 0, -1) if (r := self.ranks.get(piece[:n])) is not None and (n == 1 or r in self.halves)), None)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        size, fits, n = self.size, self.compatible, len(data)
        longest = [0] * (n + 1)
        for end, rank in self.trie.iter(data.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank  # later ends are longer
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        dead: set[int] = set()  # places from which the rest can't be encoded
        while True:
            end = at + size[token]
            if end not in dead and (last < 0 or fits[last << 32 | token]):
                out.append(token)
                if end == n:
                    return tuple(out)
                at, last, token = end, token, longest[end]
            elif (shorter := self.shorter[token]) is not None:
                token = shorter
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1

    def encode_word(self, word: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(word))))

    def encode(self, text: str) -> list[int]:
        """A match of the default pattern always begins at a space between two other characters, so that words can be matched by themselves; for other patterns the text is matched whole."""
        if not self.by_word:
            return list(self.encode_word(text))
        plain = not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or _OTHER.search(text))
        first, *more = text.split(" ") if plain else _BETWEEN.split(text)
        return list(chain(self.encode_word(first), chain.from_iterable(map(self.words.__getitem__, more))))

    def forget(self) -> None:
        """Empties what was memoised; the vocabulary stays."""
        for memo in (self.shorter, self.compatible, self.pieces, self.words):
            memo.forget()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


def _encode(path: str, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        try:
            for batch in slices(batches, 1, 1 << 20):
                ids, ends, texts = [], [0], []
                for text in raw(batch.column(1)):
                    own = known.encode(text.decode("utf-8", "replace"))
                    ids += own
                    ends.append(len(ids))
                    if decoded:
                        texts.append(known.decode(own))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, *([pa.array(texts, pa.binary())] if decoded else [])], ["id", "ids", *(["decoded"] if decoded else [])])
        finally:  # a worker that waits for another stage's task holds no memos
            known.forget()

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids) for each row: the ids of its whole text, without special tokens; with `decoded` also the bytes that the ids stand for.

    path: a file of ranks that every worker can open (a tokenizer installed with the workers). Null and empty texts have no ids. Rows and
    ids may repeat and be null; other columns are left out, so that no name clashes. A very long text is one row of one task, its time
    linear in its bytes. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_encode(path, pattern, decoded), f"id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the column `out`, which replaces one of that name: the bytes that the ids stand for; null ids give null, no ids no bytes. Rows may repeat, tables be empty."""

    def bytes_of(ids: pd.Series) -> pd.Series:
        known = vocabulary(path, pattern)
        return ids.map(lambda own: None if own is None else known.decode(list(own)))

    bytes_of.__annotations__ = {"ids": pd.Series, "return": pd.Series}
    return encoded.withColumn(out, F.pandas_udf(bytes_of, "binary")(F.col(ids_col)))


@cache
def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids, joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), *default_tokenizer(), decoded=True)
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
