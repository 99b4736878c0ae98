"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A text is cut into spans: tokens, and runs of tokens of which most are single characters, with any white space or marks between.
Each span has a lattice of readings: letters replaced by look-alikes, set apart by spaces or marks, repeated; marks at its ends may
go. Viterbi decoding finds the reading with the least cost under a character trigram model of all documents, plus the channel's
cost for each change. Spans with one reading only, which most words are, restore to themselves; so do two plain parts of two and more
letters side by side, which nothing tells from words. The restored text alone is scored.

The classifier weighs words, and their beginnings of 4 and 5 letters, by how many different toxic and clean labelled texts have
them; copies and near copies of a text count once for a label, as what they share tells no more than one of them. Terms that are toxic more often than not decide by themselves (noisy-or);
what the others tell beyond chance, for or against, is summed as log-odds, so that several weak ones can decide too. It is fitted
on a bounded sample: `toxic_rows` and `clean_rows` labelled rows at most, in hash order.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, crc_mod, cut, mix, raw, slices, table

#: The letters that a look-alike may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
MARKS = "._-*"
#: Costs of the channel, in nats: to read a look-alike as a letter, to leave it, to drop a mark or space between single characters, to keep one there.
LOOK, LEAVE, DROP, KEEP = 1.0, 8.0, 0.3, 2.5
#: To drop a mark or space that has longer parts on a side, which ordinary words have too (keeping it costs nothing); to drop a mark at an end.
JOIN, EDGE = 1.0, 0.5
#: 0: no letter, 1 to 26: a to z, 27: other letters.
_CLASS = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 0xC0 else 255 if b >= 128 else 0 for b in range(256))
_SIZE = 28


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_SIZE**3, np.int64)
    for batch in slices(batches, 0):
        x = np.frombuffer(b"\0\0" + b"\0\0".join(raw(batch.column(0))) + b"\0", np.uint8)
        x = np.frombuffer(x.tobytes().translate(_CLASS), np.uint8)
        x = x[x != 255].astype(np.int64)  # later bytes of a letter
        total += np.bincount((x[:-2] * _SIZE + x[1:-1]) * _SIZE + x[2:], minlength=_SIZE**3)
    on = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], ["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (-log P) of a character class after two others, counted over all texts; 28^3 numbers whatever the corpus."""
    counts = np.zeros(_SIZE**3)
    for r in docs.select(text_col).mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    counts = counts.reshape(-1, _SIZE) + 0.5
    return -np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32).ravel()


def class_of(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if char.isalpha() else 0


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """The options (letters, cost) of each place of a lower-case span."""
    steps: list[list[tuple[str, float]]] = []
    parts = _GAP.split(span)  # what stands between gaps, and the gaps
    for i, part in enumerate(parts):
        if i % 2:
            single = len(parts[i - 1]) == 1 or len(parts[i + 1]) == 1
            if not parts[i - 1] or not parts[i + 1]:  # at an end of the span
                steps.append([("", 0.0)])
            else:
                steps.append([("", DROP), (" ", KEEP)] if single else [("", JOIN), (" ", 0.0)])
            continue
        for m in _RUN.finditer(part):
            char, n = m[1], len(m[0])
            at_end = i == 0 and m.start() == 0 or i == len(parts) - 1 and m.end() == len(part)
            if char in LOOKS_LIKE:
                options = [(x, LOOK) for x in LOOKS_LIKE[char]] + [(char, LEAVE)]
                if char == "*" or at_end and not char.isdigit():
                    options.append(("", EDGE if at_end else DROP))
            elif char.isalpha() and n >= 3:
                steps.append([(char, 0.0), (char * 2, 0.0)])
                continue
            else:
                options = [(char, 0.0)]
            # A long run of look-alikes stands for one or two letters, like a long run of letters.
            steps += [options] * min(n, 2 if n >= 3 and len(options) > 1 else n)
    return steps


def reading_cost(text: str, costs: list[float]) -> float:
    """The cost of a text under the character model, with the place after its end."""
    a = b = 0
    total = 0.0
    for char in text:
        c = class_of(char)
        total += costs[(a * _SIZE + b) * _SIZE + c]
        a, b = b, c
    return total + costs[(a * _SIZE + b) * _SIZE]


def viterbi(span: str, costs: list[float]) -> str:
    """The reading of a lower-case span with the least cost; of several, one that is always the same."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(span):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for text, price in options:
                x, y, total = a, b, cost + price
                for char in text:
                    c = class_of(char)
                    total += costs[(x * _SIZE + y) * _SIZE + c]
                    x, y = y, c
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, (text, path))
        states = new
    end = min(states, key=lambda s: (states[s][0] + costs[(s[0] * _SIZE + s[1]) * _SIZE], s))
    best = states[end][1]
    out = []
    while best:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


_RUN = re.compile(r"(.)\1*", re.DOTALL)
_GAP = re.compile(r"([\s._-]+)")
_LETTER_RUN = re.compile(r"([^\W\d_])\1\1")
_INNER = re.compile(r"\w[._-]+\w")
_LOOKS = re.compile("[" + re.escape("".join(LOOKS_LIKE)) + "]")
_WORD = re.compile(r"[^\W_]+")
#: What stands around a word and is no look-alike.
_EDGE = "\"',.;:?#%&)[]{}<>=~^`/\\-_"
_ONE = rb"(?:[!-~]|[\xc2-\xf4][\x80-\xbf]+)"
#: Single characters set apart by white space and marks, and parts of two after them ("z o rk"), in bytes (all non-ASCII bytes belong to characters).
_SPACED = re.compile(rb"(?<!\S)" + _ONE + rb"(?:[ \t]+[._*-]*|[._*-]+[ \t]+)" + _ONE + rb"(?:(?:[ \t]+[._*-]*|[._*-]+[ \t]+)" + _ONE + rb"{1,2})+(?!\S)")
_WIDE = re.compile(r"\s+")


def restore_token(token: str, costs: list[float]) -> str:
    """A lower-case token without white space, restored."""
    core = token.strip(_EDGE)
    if core.isalpha() and not _LETTER_RUN.search(core):
        return core
    if any(x.isalpha() for x in core) and (_LETTER_RUN.search(core) or _INNER.search(core) or _LOOKS.search(core)):
        return viterbi(core, costs)
    return core


def restore_span(span: bytes, costs: list[float]) -> str:
    """Tokens that are mostly single characters, restored."""
    return viterbi(_WIDE.sub(" ", span.decode("utf-8", "replace").lower().strip(_EDGE)), costs)


def _squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


@dataclass
class Toxicity:
    """costs: of the character model. weights: of strong words and beginnings (with a ^ before them). prior: of a text without any.

    evidence: log-odds of the terms that have no weight of their own, those against a text being toxic below zero."""

    costs: np.ndarray
    weights: dict[str, float]
    prior: float
    evidence: dict[str, float] = field(default_factory=dict)


def _terms(word: str) -> tuple[str, ...]:
    return (word, *("^" + word[:k] for k in (4, 5) if len(word) > k))


class _Scorer:
    def __init__(self, model: Toxicity):
        self.model, self.costs = model, model.costs.tolist()
        self.tokens = Memo(self._strongest, 300_000)

    def _strongest(self, token: bytes) -> tuple[tuple[str, float], ...]:
        weights, evidence = self.model.weights, self.model.evidence
        words = set(_WORD.findall(restore_token(token.decode("utf-8", "replace").lower(), self.costs)))
        found, weak = [], []
        for word in words:
            for form in {word, _squeezed(word)}:
                if got := max(((weights[t], t) for t in _terms(form) if t in weights), default=None):
                    found.append((got[1], got[0]))
                else:
                    weak += ((abs(evidence[t]), t) for t in _terms(form) if t in evidence)
        # The terms of a token tell the same thing, so one of them counts.
        return tuple(found) or ((max(weak)[1], 0.0),) if found or weak else ()

    def score(self, text: bytes) -> float:
        """Of the restored text: spans of single characters are put in place of what they are restored from."""
        text = _SPACED.sub(lambda m: restore_span(m[0], self.costs).encode(), text)
        found = {t: p for hits in filter(None, map(self.tokens.__getitem__, text.split())) for t, p in hits}
        rest, odds, strong = 1.0, 0.0, False
        for t in sorted(found):
            if p := found[t]:
                rest, strong = rest * (1 - p), True
            else:
                odds += self.model.evidence[t]
        if not odds:
            return 1 - rest if strong else self.model.prior
        weak = 1 / (1 + (1 / self.model.prior - 1) * math.exp(-max(-500.0, min(500.0, odds))))
        if not strong:
            return weak
        # Evidence against never takes away from a strong term.
        return 1 - rest * (1 - weak) if weak >= 0.5 else 1 - rest


def restore_text(text: str, costs: list[float]) -> str:
    """The whole text, lower case, with every span restored and single spaces."""
    own = _SPACED.sub(lambda m: restore_span(m[0], costs).encode(), text.lower().encode()).decode("utf-8", "replace")
    return " ".join(restore_token(x, costs) for x in own.split())


def restore(docs: DataFrame, costs: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, restored) for each row; null texts are empty. Rows may repeat; other columns are left out; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.tolist()
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([restore_text(x.decode("utf-8", "replace"), own) for x in raw(batch.column(1))])], ["id", "restored"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, restored string")


#: Min-hashes of five-word shingles: as many bands, of so many hashes each. Texts of Jaccard similarity 0.8 share a band with probability 0.999.
BANDS, BAND_ROWS = 10, 3


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bands) of texts; texts under five words have one shingle."""
    seeds = (np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    for batch in slices(batches, 1):
        out = []
        for text in raw(batch.column(1)):
            words = np.fromiter(map(xxhash.xxh64_intdigest, text.lower().split()), np.uint64)
            least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
            with np.errstate(over="ignore"):
                for at in range(0, max(1, len(words) - 4), 20_000):
                    own = words[at : at + 20_004]
                    n = max(1, len(own) - 4)
                    grams = sum((own[i : i + n] * np.uint64(2 * i + 3) for i in range(min(5, len(own)))), np.zeros(n, np.uint64))
                    for k in range(0, len(seeds), BAND_ROWS):
                        least[k : k + BAND_ROWS] = np.minimum(least[k : k + BAND_ROWS], mix(grams ^ seeds[k : k + BAND_ROWS]).min(axis=1))
                out.append(mix((least.reshape(BANDS, BAND_ROWS) * np.array([1, 3, 5], np.uint64)).sum(axis=1)).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["key", "bands"])


def _first_of_near_copies(rows: DataFrame) -> set:
    """Keys of one text of each group that shares bands, and of each label. rows: the bounded sample (key, text, toxic)."""
    root: dict = {}

    def find(x):  # noqa: ANN001, ANN202
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    bands = rows.select("__text", "text").distinct().mapInArrow(_bands, "key string, bands array<long>").collect()
    for r in bands:
        for i, band in enumerate(r.bands):
            root[find((i, band))] = find(r.key)
    first: dict = {}
    for key, toxic in sorted((r["__text"], r["__toxic"]) for r in rows.select("__text", "__toxic").collect()):
        first.setdefault((find(key), toxic), key)
    return {(key, toxic) for (_, toxic), key in first.items()}


def _texts_by_term(shared, strong=None):  # noqa: ANN001, ANN202
    """Rows (term, t, c): numbers of toxic and clean texts with the term, of a task's texts. With strong words given the terms are the beginnings of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs = shared.value.tolist()
        known = None if strong is None else strong.value

        def terms_of(token: bytes) -> tuple[str, ...]:
            words = _WORD.findall(restore_token(token.decode("utf-8", "replace").lower(), costs))
            return tuple(words) if known is None else tuple({t for word in words if word not in known for t in _terms(word)[1:]})

        terms = Memo(terms_of, 200_000)
        for batch in slices(batches, 0, 4 << 20):
            counts = Counter(), Counter()
            for text, toxic in zip(raw(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[toxic == 1].update({t for token in set(text.split()) for t in terms[token]})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][t] for t in names], pa.int64()) for k in (1, 0))], ["term", "t", "c"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_rows: int = 4000, clean_rows: int = 8000, doubt: float = 9.0) -> Toxicity:
    """Fits on the labelled rows of docs (at most toxic_rows and clean_rows of them) after counting characters over all of docs.

    labels: id and label; an id labelled more than once is toxic if any label says so; null labels and ids are left out; of several documents of an id
    that with the smallest SHA-256 counts. A term's
    weight is (t + share * doubt) / (t + c + doubt), t and c being the different toxic and clean texts with it, near copies left out, c as of as many
    clean rows as there are to the toxic ones, share that of the toxic among the labelled rows. Terms whose counts chance explains are left
    out (twice the log-likelihood ratio is 2 ln(number of terms) at most); all others stay: those of weight 0.5 and more are strong, the
    others have the log-odds of their weight against the share as evidence. Their number is bounded by the sample's different words.
    Without labels of both kinds every score is 0.05. Copies and near copies of a text count once for a label; extra columns are left out.
    """
    spark = docs.sparkSession
    costs = character_model(docs, text_col)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__toxic"))
    n = {r["__toxic"]: r["count"] for r in known.groupBy("__toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return Toxicity(costs, {}, 0.05)
    order = F.xxhash64("__id")
    sample = known.filter("__toxic = 1").orderBy(order, "__id").limit(toxic_rows).unionByName(known.filter("__toxic = 0").orderBy(order, "__id").limit(clean_rows))
    # The sample has toxic_rows + clean_rows rows at most, and of an id that is there several times one text.
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__text")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id").groupBy("__id", "__toxic").agg(F.min_by("text", key).alias("text"))
    rows = cut(rows.groupBy(key, "__toxic").agg(F.first("text").alias("text")).repartition(max(8, spark.sparkContext.defaultParallelism)))
    # As many keys as the sample has rows, at most.
    first = spark.createDataFrame(sorted(_first_of_near_copies(rows)), "__text string, __toxic int")
    rows = cut(rows.join(F.broadcast(first), ["__text", "__toxic"]).select("text", "__toxic").repartition(max(8, spark.sparkContext.defaultParallelism)))
    texts = {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}
    # Of as many clean rows as there are to each toxic one.
    scale = (n[0] / n[1]) / (min(n[0], clean_rows) / min(n[1], toxic_rows))
    share, drawn = n[1] / (n[0] + n[1]), texts.get(1, 0) / max(1, sum(texts.values()))
    weight = (F.col("t") + F.lit(share * doubt)) / (F.col("t") + F.lit(scale) * F.col("c") + F.lit(doubt))
    # Twice the log-likelihood ratio of the term's own share of toxic texts to that of all texts.
    t, c, both = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    beyond = sum((F.when(x > 0, 2 * x * F.log(x / both / F.lit(of))).otherwise(0.0) for x, of in ((t, max(drawn, 1e-9)), (c, max(1 - drawn, 1e-9)))), F.lit(0.0))
    odds = F.log(F.col("w") / (1 - F.col("w"))) - F.lit(math.log(share / (1 - share)))

    def fit(strong=None) -> tuple[dict[str, float], dict[str, float]]:  # noqa: ANN001
        counts = cut(rows.mapInArrow(_texts_by_term(shared, strong), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
        # Of as many terms without a meaning, none is likely to reach this by chance.
        by_chance = 2 * math.log(max(2, counts.count()))
        found = counts.withColumns({"w": weight, "beyond": beyond}).filter(F.col("beyond") > by_chance).withColumn("e", odds).withColumn("strong", F.expr("w >= 0.5 and e > 0"))
        kept = sorted(found.select("term", "w", "e", "strong").collect())
        return {r.term: r.w for r in kept if r.strong}, {r.term: r.e for r in kept if not r.strong}

    shared = spark.sparkContext.broadcast(costs)
    strong, weak = fit()
    # A beginning doesn't get its weight from words that have their own.
    more = fit(spark.sparkContext.broadcast(set(strong)))
    return Toxicity(costs, strong | more[0], min(0.2, 0.5 * share), weak | more[1])


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row; null and empty texts get the prior. Scores lie in 0 to 1.

    Rows and ids may repeat and be null; equal texts score the same. A very long text is scored whole by one task. Other columns are left
    out, so that no name clashes; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Scorer(shared.value)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(own.score, raw(batch.column(1))), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def score_kept(docs: DataFrame, model: Toxicity, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the column `out`, which replaces one of that name; other columns pass through unchanged. Rows are treated as in score()."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(parts):  # noqa: ANN001, ANN202
        own = _Scorer(shared.value)
        for texts in parts:
            yield texts.map(lambda x: own.score(x.encode()))

    scored.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(scored, "double")(F.coalesce(F.col(text_col), F.lit(""))))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Toxicity:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 5) != 0)
    return train(docs.select("doc_id", "text"), labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fitted(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
