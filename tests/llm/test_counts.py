"""Collocations, packing, filter audit: against SQL, brute force and odd rows."""

import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import collocations, filter_audit, packing

SF = "/root/testdata/sf0.001"


# -- collocations


def _phrases(texts, least=30, top=2000):
    """The contract, word by word."""
    counts, words = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for mark in ".,;:!?\x0b\x0c\r":
            text = (text or "").replace(mark, "\n")
        for piece in text.translate(lower).split("\n"):
            own = [w for w in piece.replace("\t", " ").split(" ") if w]
            words[lang] += len(own)
            for n in range(1, 5):
                counts[lang].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    rows = []
    for lang, f in counts.items():
        known = {p: a for p, a in f.items() if a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in known.items():
            if len(p) > 1 and not any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in known.items()):
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows += [(lang, i, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(rows)


def _found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_collocations_match_sql(spark, same):
    assert same(collocations.op11_collocations(spark, "/root/testdata/sf0.01"), collocations.ORACLE, "/root/testdata/sf0.01") > 100


ODD = [("en", None), (None, ""), (None, "A b. a B c"), ("en", "."), ("en", " \t "), ("en", "a b c d e " * 40), ("en", "a b c d e"), ("en", "a b c d e"), ("", "é x\té x.é\x0bx"), (None, "a b c! a b"), ("en", "x" * 3000 + " a b"), ("de", "a\xa0b c d " * 3)]


@pytest.mark.parametrize("shard_bytes", [8, 100, 1 << 20])
def test_collocations_of_odd_rows(spark, shard_bytes):
    docs = spark.createDataFrame(ODD, "lang string, text string").withColumns({"shard": F.lit(1), "n": F.lit("n"), "phrase": F.lit("p")})
    for least, top in ((2, 2000), (1, 3)):
        assert _found(collocations.collocations(docs.repartition(3), least=least, top=top, shard_bytes=shard_bytes)) == _phrases(ODD, least, top)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_collocations_of_any_texts(spark):
    rng = np.random.default_rng(5)
    texts = [("xy"[int(rng.integers(2))], "".join(rng.choice([" a", " b", " B", " c", " d", ". ", "\t", "\n", " a b c"], 30))) for _ in range(60)]
    assert _found(collocations.collocations(spark.createDataFrame(texts, "lang string, text string").repartition(4), least=5, shard_bytes=200)) == _phrases(texts, 5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_intervals_are_the_counts_of_n_grams(ids):
    ids = np.array([*ids, 0], np.uint32)
    grams = collocations.Grams(ids, 4)
    for n in range(1, 5):
        want = Counter(g for i in range(len(ids) - n + 1) if 0 not in (g := tuple(ids[i : i + n].tolist())))
        heads, counts, at = grams.intervals(n)
        assert {tuple(ids[h : h + n].tolist()): c for h, c in zip(heads, counts.tolist(), strict=True)} == want
        assert [tuple(ids[h : h + n].tolist()) for h in heads] == sorted(want)
        assert all((at[i] > 0) == (tuple(ids[i : i + n].tolist()) in want and i + n <= len(ids)) for i in range(len(ids)))


def test_scores_are_exact_beyond_64_bits():
    a = np.array([2**60 + 1, 3], np.int64)
    assert collocations._score(a, 2 * a + 1).tolist() == [2_000_000 * x // (2 * x + 1) for x in a.tolist()]


# -- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def _holds(rows, texts, tokenizer, size):
    """Every id of every text in one piece, sequences without gaps, all full but the last."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or k == len(by_sequence) - 1


def test_packing_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    _holds(packing.op12_packing(spark, SF).collect(), texts, tokenizer, packing.SEQUENCE_TOKENS)


TEXTS = ["", None, "a", "It's  a TEST\t\n x", "é è 漢字 🙂 z", "word " * 5000, "x" * 3000, "<|endoftext|> 12345 '' \r\n  end  ", "a\xa0b c\x1fd", "é ́a Σς ΑΣ", "same", "same"]


@pytest.mark.parametrize("parts", [1, 5])
def test_packing_of_odd_rows(spark, tokenizer, parts):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").withColumns({"id": F.lit("i"), "part": F.lit("p"), "ids": F.lit(1)}).repartition(parts)
    own = packing.pieces(packing.tokenized(docs, packing.default_tokenizer()), 64)
    rows = own.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset").collect()
    _holds(rows, dict(enumerate(TEXTS)), tokenizer, 64)
    given, made = defaultdict(dict), {r.sequence_id: r for r in packing.sequences(own, 64, 7).collect()}
    for r in own.collect():
        given[r.sequence_id][r.offset] = bytes(r.ids)
    assert set(made) == set(given)
    for k, by_offset in given.items():
        data = b"".join(by_offset[x] for x in sorted(by_offset))
        n = len(data) // 4
        assert made[k].n_tokens == n and bytes(made[k].ids) == data + (b"" if n & (n - 1) == 0 else b"\x07\0\0\0" * (64 - n))
    empty = packing.pieces(packing.tokenized(docs.limit(0), packing.default_tokenizer()), 64)
    assert empty.count() == 0 and packing.sequences(empty, 64).count() == 0


def test_packing_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = packing.pieces(packing.tokenized(docs, packing.default_tokenizer())).collect()
    assert sorted((repr(r.id), r.length) for r in rows) == [("1", 3), ("1", 3), ("None", 1), ("None", 2)]
    assert sum(r.length for r in rows) == 9 and {r.sequence_id for r in rows} == {0}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t'$#*_séÀßµªº×漢A1.,!<|>́\xa0Σﬁ", max_size=30))
def test_words_are_encoded_by_themselves(tokenizer, text):
    assert np.frombuffer(packing.encoder(packing.default_tokenizer())(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# -- filter audit


def test_filter_audit_matches_sql(spark, same):
    assert same(filter_audit.op13_filter_audit(spark, SF), filter_audit.ORACLE, SF) >= 600


def _audited(docs, labels):
    """The contract, document by document and order by order."""
    label = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        words = [w for w in words if w]
        upper = sum("A" <= c <= "Z" for c in text)
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text), any(c in "#$%&*|" for c in text), again]
        rows.append((part or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, label(i, 1), label(i, 2)))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in rows if r[0] == part and f in r[1]]
                shapley[part, f] += len(here)
                out.append((part, "".join(order), step, len(left), len(here), len(failing) - len(here), sum(r[1] == {f} for r in failing), sum(r[2] for r in here), sum(r[3] for r in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


LONG = " ".join(f"w{i}" for i in range(120))
DOCS = [(5, LONG, "en"), (3, LONG, "en"), (9, LONG, "de"), (9, LONG, "en"), (9, LONG, "en"), (3, LONG, None), (None, LONG, "en"), (None, None, None), (1, None, ""), (2, "", "en"), (4, "a b", "en"), (4, "A B", "en"), (6, "x " * 5000, "en"), (7, LONG + " 100%", "en"), (8, LONG.upper(), "fr"), (10, "É" * 3 + "A", "fr"), (11, "a\x1cb\xa0c " * 60, "fr")]
LABELS = [(5, 1, 0), (5, 0, 1), (3, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1), (8, 0, 0)]


@pytest.mark.parametrize(("parts", "digest", "held"), [(1, None, None), (6, None, None), (4, len, None), (3, lambda text: 1, 10)])
def test_filter_audit_of_odd_rows(spark, monkeypatch, parts, digest, held):
    """Also where all texts share a fingerprint, and where a task forgets its texts."""
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string").withColumns({"id": F.lit("i"), "part": F.lit(1), "mask": F.lit("m")}).repartition(parts)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1))
    options = {"held_bytes": held or filter_audit.HELD_BYTES, "digest": digest or filter_audit.fingerprint}
    plain = filter_audit.masks
    monkeypatch.setattr(filter_audit, "masks", lambda *a: plain(*a, **options))
    found = filter_audit.audit(docs, labels)
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == _audited(DOCS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels.limit(0)).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_a_text_travels_once_from_each_task():
    rows = [(i, "same text", "en") for i in range(1000)]
    sent = list(filter_audit._routed(filter_audit.FILTERS, 1 << 20, filter_audit.fingerprint)(rows))
    assert sum(r[1][1] is not None for r in sent) == 1 and len(sent) == 1000
    assert len({key[0] for key, _ in sent}) == 1000
