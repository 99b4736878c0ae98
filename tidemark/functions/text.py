"""Text functions as column expressions; all of them run inside the JVM but the NFKC form, which Spark has no function for."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a with 32 bits: the prime, and the seeds of the two passes.
FNV_PRIME, FNV_SEEDS = 16777619, (0x811C9DC5, 0x9E3779B9)


def canonical_text(text: Column) -> Column:
    """Lower case, every run of other than letters and digits one space, trimmed. For text that is in NFKC already."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def nfkc(text: Column) -> Column:
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    form.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(form, "string")(text)


def words(canonical: Column) -> Column:
    return F.filter(F.split(canonical, " "), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once a row: within functions over arrays an expression is worked out anew for each element and wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def context_terms(canonical: Column, most: int) -> Column:
    """The first different words of two characters at least, or digits."""
    return F.slice(F.array_distinct(F.filter(words(canonical), lambda w: (F.length(w) >= 2) | w.rlike(r"^\p{N}+$"))), 1, most)


def phrases(canonical: Column, longest: int = 6) -> Column:
    """All runs of 1 to `longest` words."""

    def runs(own: Column) -> Column:
        of_size = lambda k: F.when(F.size(own) >= k, F.transform(F.sequence(F.lit(1), F.size(own) - k + 1), lambda i: F.array_join(F.slice(own, i, k), " "))).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), of_size))

    return F.array_distinct(let(words(canonical), runs))


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def bounded_text(text: Column, most: int) -> Column:
    return F.trim(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, most))


def clip_middle(text: Column, most: int, mark: str = "\n[...]\n") -> Column:
    """Texts over `most` characters keep their start (55 %) and their end around a mark."""
    room = most - len(mark)
    head = room * 55 // 100
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(mark), F.right(text, F.lit(room - head))))


def unique_strings(values: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")), 1, most)


def token_estimate(text: Column) -> Column:
    """Tokens that a text may take: ASCII words by 3.5 characters, any other character but white space one; 12 % on top."""
    own = F.coalesce(text, F.lit(""))
    in_words = F.aggregate(F.regexp_extract_all(own, F.lit("([A-Za-z0-9_]+)")), F.lit(0).cast("long"), lambda n, w: n + F.ceil(F.length(w) / 3.5))
    return F.ceil((in_words + F.length(F.regexp_replace(own, r"[A-Za-z0-9_\s]+", ""))) * 1.12).cast("long")


def strip_tagged_block(text: Column, tag: str) -> Column:
    """Without the tag's self-closing, closed, or never closed block."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?is)<{tag}\b[^>]*/>", "")
    out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*$", "")


def _units(text: Column) -> Column:
    """UTF-16 code units."""

    def unit(char: Column) -> Column:
        point = F.ascii(char).cast("long")
        return F.when(point < 65536, F.array(point)).otherwise(F.array(55296 + F.shiftright(point - 65536, 10), 56320 + ((point - 65536) % 1024)))

    return F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), unit))


def fnv1a(text: Column, seed: int) -> Column:
    step = lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(_units(text), F.lit(seed).cast("long"), step)


def hash_text(text: Column) -> Column:
    """16 hex digits of two FNV-1a passes; null is the empty text."""
    own = F.coalesce(text, F.lit(""))
    return F.lower(F.concat(*(F.lpad(F.hex(fnv1a(own, seed)), 8, "0") for seed in FNV_SEEDS)))


def deterministic_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), hash_text(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))))


def on_word_boundaries(haystack: Column, needle: Column) -> Column:
    """Whether canonical text holds other canonical text as whole words."""
    return F.concat(F.lit(" "), haystack, F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))


def jaccard(left: Column, right: Column) -> Column:
    """Of two sets (arrays without repeats); of two empty ones 0."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either > 0, both / either).otherwise(0.0)
