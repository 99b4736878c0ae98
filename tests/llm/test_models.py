"""Toxicity by held-out accuracy, Kneser-Ney against a plain version, the pipeline stage by stage."""

import itertools
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import kneser_ney, toxicity

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("given", "read"), [("st0ne", "stone"), ("plain", "plain"), ("riverrrr", "river"), ("w.a.t.e.r", "water")])
def test_spans_are_restored(spark, given, read):
    words = spark.createDataFrame([("the stone river water plain of a river and the water on stone " * 200,)], "text string")
    assert toxicity.restore_token(given, toxicity.character_model(words).tolist()) == read


@pytest.mark.parametrize("given", ["zo.rk", "z-o-rk", "z o r k", "z  o  r  k", "z o rk", "z.o.r.k", "z0rk!", "zork!!", "z - o - r - k", "(zork)", "Zoooork"])
def test_ways_to_hide_a_word(spark, given):
    text = "you zork of a word and an other one, the day is fine. " * 200
    costs = toxicity.character_model(spark.createDataFrame([(text,)], "text string")).tolist()
    assert toxicity.restore_text(given, costs) == "zork"
    assert toxicity.restore_text(f"you {given} and the day", costs) == "you zork and the day"


def test_viterbi_finds_the_cheapest_reading(spark):
    """Against enumeration of the lattice."""
    costs = np.random.default_rng(4).uniform(0.1, 6, 28**3).tolist()
    for span in ("z0rk", "a$$", "w 0 r d", "1!1", "sooo", "x*y-z", "h3ll0!", "a.b c", "$aaa$"):
        steps = toxicity.lattice(span)
        every = {}
        for path in itertools.product(*steps):
            text = "".join(x for x, _ in path)
            every[text] = min(every.get(text, 1e9), sum(p for _, p in path) + toxicity.reading_cost(text, costs))
        assert every[toxicity.viterbi(span, costs)] == pytest.approx(min(every.values()))


def test_scores_by_hand():
    model = toxicity.Toxicity(np.full(28**3, 1.0, np.float32), {"zork": 0.9, "^blib": 0.6}, 0.1, {"fine": -2.0, "vrum": 3.0})
    own = toxicity._Scorer(model)
    odds = lambda x: 1 / (1 + 9 * math.exp(-x))
    assert own.score(b"") == 0.1 and own.score(b"no such word") == 0.1
    assert own.score(b"zork") == pytest.approx(0.9) and own.score(b"zork blibbing") == pytest.approx(1 - 0.1 * 0.4)
    assert own.score(b"fine") == pytest.approx(odds(-2)) and own.score(b"vrum fine") == pytest.approx(odds(1))
    assert own.score(b"zork fine") == pytest.approx(0.9) and own.score(b"zork vrum") == pytest.approx(1 - 0.1 * (1 - odds(3)))


def test_held_out_accuracy(spark):
    rows = toxicity.op6_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic = [r for r in held if labels[r.doc_id] == 1]
    clean = [r for r in held if labels[r.doc_id] == 0]
    print(f"held out: {len(toxic)} toxic, recall {sum(r.predicted for r in toxic) / len(toxic):.3f}; {len(clean)} clean, rejected {sum(r.predicted for r in clean) / len(clean):.4f}")
    recall, wrong = sum(r.predicted for r in toxic) / len(toxic), sum(r.predicted for r in clean) / len(clean)
    assert len(toxic) >= 50 and recall >= 0.8 and wrong <= 0.02  # some labels are noise


def test_toxicity_of_odd_rows(spark):
    texts = ["", None, "bad zork word", "b4d z0rk", "fine words " * 400_000, "z o r k", "\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"score": F.lit("s"), "id": F.lit(1), "toxic": F.lit(9)})
    model = toxicity.Toxicity(np.full(28**3, 1.0, np.float32), {"zork": 0.9}, 0.05)
    found = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert found[0] == found[1] == found[4] == found[6] == 0.05
    assert found[2] == found[3] == found[5] == pytest.approx(0.9)
    kept = toxicity.score_kept(docs, model, out="__score")
    assert {r.doc_id: r["__score"] for r in kept.collect()} == found and kept.columns[:-1] == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert (none.weights, none.prior) == ({}, 0.05)
    assert len(toxicity.restore(docs, model.costs).collect()) == len(texts)


def test_toxic_terms_count_texts_not_words_before_them(spark):
    """`zork` follows the same word in every toxic text; `blib` and `vrum` are weak, but together they decide."""
    toxic = [f"you zork tox{i} a{i % 7}" for i in range(20)] + [f"they {w} mess{i} a{i % 7}" for w in ("blib", "vrum") for i in range(6)] + ["the same words again"] * 30
    clean = [f"fine day{i} a{i % 7} the" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", f"int(doc_id < {len(toxic)}) as toxic"))
    assert model.weights["zork"] > 0.6 and {"blib", "vrum"} <= model.evidence.keys() and "same" not in model.weights | model.evidence
    texts = ["a zork", "some blib", "some vrum", "some blib vrum", "the same again", "fine a1"]
    got = {r.id: r.score >= 0.5 for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(texts))] == [True, False, False, True, False, False]


def _plain_model(texts, order):
    """Interpolated modified Kneser-Ney with dicts: (P(word | words before), counts). N-grams from a text's start keep their plain count."""
    levels = [Counter() for _ in range(order + 1)]
    counts = Counter()
    for text in texts:
        own = ["<s>", *kneser_ney.words_of(text.encode()), b"</s>"]
        counts.update(own[1:])
        for i in range(1, len(own)):
            n = min(order, i + 1)
            levels[n][tuple(own[i - n + 1 : i + 1])] += 1
    for k in range(order, 1, -1):
        for gram in list(levels[k]):
            levels[k - 1][gram[1:]] += 1
    d = [None, *(kneser_ney.discounts(*(sum(v == n for v in levels[k].values()) for n in (1, 2, 3, 4))) for k in range(1, order + 1))]
    off = lambda k, n: d[k][min(n, 3) - 1] if n else 0
    after = defaultdict(dict)
    for k in range(2, order + 1):
        for gram, n in levels[k].items():
            after[gram[:-1]][gram[-1]] = n
    total = sum(levels[1].values())

    def p(context, word):
        k = len(context) + 1
        if k == 1:
            n = levels[1][word,]
            return max(n - off(1, n), 0) / total + sum(off(1, x) for x in levels[1].values()) / total / (len(counts) + 1)
        own, lower = after.get(context), p(context[1:], word)
        if not own:
            return lower
        n, all_ = own.get(word, 0), sum(own.values())
        return max(n - off(k, n), 0) / all_ + sum(off(k, x) for x in own.values()) / all_ * lower

    return p, counts, after


TRAIN = ["the cat sat on the mat", "the cat ate", "A dog sat on the Cat", "", "the dog ate the mat and the cat", "one two three", "x", "the cat sat on the mat"] * 2 + ["rare words here", "the end of it"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_kneser_ney_is_that_of_a_plain_version(spark, order, monkeypatch):
    p, counts, after = _plain_model(TRAIN, order)
    v, n = len(counts), sum(counts.values())
    for context in after:
        assert sum(p(context, w) for w in counts) + p(context, b"unseen") == pytest.approx(1)
    model = kneser_ney.count(spark.createDataFrame([(t or None,) for t in TRAIN], "text string").repartition(3), order=order)
    assert (model.vocabulary, model.tokens) == (v, n)
    docs = [(1, "the cat sat"), (2, None), (3, ""), (4, "never seen words\tAND the\x0bcat"), (1, "mat"), (None, "x " * 3000), (5, "the cat sat on the mat and a dog ate")]
    rows = kneser_ney.score(spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("z"), "score": F.lit(1)}), model).collect()
    want = []
    for own, text in docs:
        tokens = ["<s>", *kneser_ney.words_of((text or "").encode()), b"</s>"]
        score = sum(math.log10(p(tuple(tokens[max(0, i - order + 1) : i]), tokens[i])) for i in range(1, len(tokens)))
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[1:])
        want.append((repr(own), len(tokens) - 1, sum(t in counts for t in tokens[1:]), pytest.approx(base), pytest.approx(score)))
    got = sorted((repr(r.id), r.n_tokens, r.n_known, r.base_score, r.score) for r in rows)
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in rows)


def test_chunks_and_narrow_ranges_change_nothing(spark, monkeypatch):
    """Counting and looking up few tokens at a time, over many ranges; in this process, so that the sizes hold."""
    monkeypatch.setattr(kneser_ney, "CHUNK", 8)
    texts = [t.encode() for t in TRAIN]
    seq, place = kneser_ney.sequence_of(texts, kneser_ney._hashes())
    assert (place == 0).sum() == len(texts) and seq[place == 0].tolist() == [kneser_ney.START] * len(texts)
    for order in (1, 2, 3):
        each = {}
        for chunk in (8, 10_000):
            monkeypatch.setattr(kneser_ney, "CHUNK", chunk)
            grams = Counter()
            for batch in kneser_ney._count(order, 3, 5)([pa.RecordBatch.from_arrays([pa.array(TRAIN)], ["text"])]):
                for r in batch.to_pylist():
                    words, (counts,) = kneser_ney.unpacked(r["block"], r["level"], 1)
                    slots = kneser_ney._slot(kneser_ney.key_of(words), 15)
                    assert set(slots.tolist()) == {r["part"] * 5 + r["sub"]}
                    for n, *own in zip(counts.tolist(), *(w.tolist() for w in words), strict=True):
                        grams[r["kind"], *own] += n
            each[chunk] = grams
        assert each[8] == each[10_000]


def test_a_missing_part_of_the_model_fails(spark):
    model = kneser_ney.count(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    (level, part), n = next((k, n) for k, n in model.sizes.items() if n and k[0] == 3)
    path = f"{kneser_ney._local(model.folder)}/{level}-{part}.key"
    docs = spark.createDataFrame([(1, "the cat sat on the mat and the dog ate the cat")], "doc_id long, text string")
    with open(path, "r+b") as file:
        file.truncate(8 * (n - 1))
    with pytest.raises(Exception, match="rows, not"):
        kneser_ney._Tables(model).array(level, part, "key", np.uint64)
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        kneser_ney._Tables(model).array(level, part, "key", np.uint64)
    with pytest.raises(Exception, match="No such file"):
        kneser_ney.score(docs.unionByName(spark.createDataFrame([(2, t) for t in TRAIN], "doc_id long, text string")), model).collect()


def test_a_very_long_text(spark):
    """Some megabytes as one text: the score is the sum over its tokens, piece by piece."""
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(["the", "cat", "sat", "on", "mat", "\n", "zz"], 600_000).tolist())
    model = kneser_ney.count(spark.createDataFrame([(t,) for t in TRAIN], "text string"))
    (row,) = kneser_ney.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    seq, place = kneser_ney.sequence_of([text.encode()], kneser_ney._hashes())
    p, base, counts = kneser_ney._log10(model, seq, place)
    assert row.n_tokens == len(seq) - 1 and row.n_known == (counts[1:] > 0).sum()
    assert (row.score, row.base_score) == (pytest.approx(p[1:].sum()), pytest.approx(base[1:].sum()))


def test_kneser_ney_without_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = kneser_ney.count(empty)
    assert (model.vocabulary, model.tokens) == (0, 0)
    (row,) = kneser_ney.score(spark.createDataFrame([(1, "some words")], "doc_id long, text string"), model).collect()
    assert row.n_known == 0 and math.isfinite(row.score) and math.isfinite(row.base_score)
    assert kneser_ney.score(empty, model).count() == 0


def test_kneser_ney_query(spark):
    """Counts and base of the whole query against plain counting; held-out texts are likelier than under the base."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokens = {i: [*kneser_ney.words_of(t.encode()), b"\n"] for i, t in docs.items()}
    learnt = Counter(w for i, own in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    n, v = sum(learnt.values()), len(learnt)
    rows = kneser_ney.op10_kneser_ney(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in learnt for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_n_grams_of_one_context_are_in_all_ranges(spark):
    text = " ".join(f"hot w{i}" for i in range(4000))
    model = kneser_ney.count(spark.createDataFrame([(text,)], "text string"), order=2)
    sizes = [model.sizes[2, p] for p in range(model.parts)]
    assert max(sizes) < 1.2 * min(sizes)


def test_counts_that_do_not_fit_are_refused(tmp_path):
    out = kneser_ney._Writer(f"file://{tmp_path}", "t", kneser_ney._COUNT + kneser_ney._SUMS)
    row = lambda count, one: (np.array([7], np.uint64), *kneser_ney._split(np.array([count])), np.array([count]), *(np.array([x]) for x in (one, 0, 0)))
    out.add(*row(2**40 - 1, 2**32 - 1))
    for count, one in ((2**40, 1), (5, 2**32)):
        with pytest.raises(OverflowError):
            out.add(*row(count, one))


def test_words_of_odd_texts_are_told_apart():
    """Against plain splitting: one hash for each word, whatever its length and bytes, and wherever a text is cut."""
    texts = [b"", b" ", b"\x00", b"\x00\x00", b"a\x00", b"a", b"A a", b"x" * 64, b"x" * 65, b"x" * 66, b"abcdefg abcdefgh abcdefghi", "\u00e9 \u00dc\u0085".encode(), b"a\x1cb", b"a\x0bb\x0cc\rd\te\nf ", b"many words " * 200_000]
    seq, place = kneser_ney.sequence_of(texts, kneser_ney._hashes())
    hashes, at = {}, 0
    for text in texts:
        words = kneser_ney.words_of(text)
        assert seq[at] == kneser_ney.START and seq[at + len(words) + 1] == kneser_ney.END
        assert place[at : at + len(words) + 2].tolist() == list(range(len(words) + 2))
        for word, own in zip(words, seq[at + 1 : at + 1 + len(words)].tolist(), strict=True):
            assert hashes.setdefault(word, own) == own
        at += len(words) + 2
    assert at == len(seq) and len(set(hashes.values()) - {kneser_ney.START, kneser_ney.END}) == len(hashes)


def test_rows_of_many_different_numbers(spark):
    """Of 600 pairs, each as often as none else, most are listed apart; counts and sums of followers are as counted."""
    texts = [f"hot w{i}" for i in range(600) for _ in range(i + 1)]
    model = kneser_ney.count(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), order=3)
    assert sum(apart for _, apart, *_ in model.apart.values()) > 0
    tables = kneser_ney._Tables(model)
    seq, _ = kneser_ney.sequence_of([f"hot w{i}".encode() for i in range(600)], kneser_ney._hashes())
    counts, numbers = tables.words(seq)
    start, hot, word, end = numbers.reshape(-1, 4).astype(np.uint64).T
    assert counts.reshape(-1, 4)[:, 2].tolist() == list(range(1, 601)) and len(set(word.tolist())) == 600
    assert max(numbers) == model.vocabulary and hot[0] in (1, 2)
    assert tables.find(3, kneser_ney.key_of([start, hot, word]))[0].tolist() == list(range(1, 601))
    found = tables.find(2, kneser_ney.key_of([hot, word]))
    assert found[0].tolist() == [1] * 600 and found[1].tolist() == list(range(1, 601))
    (total, one, two, more) = tables.find(2, kneser_ney.key_of([start, hot]))[1:, 0]
    assert (total, one, two, more) == (600 * 601 // 2, 1, 1, 598)


@pytest.mark.parametrize("columns", [1, 2, 3, 4, 6])
@pytest.mark.parametrize("base", [3, 1 << 10, 1 << 17, 1 << 24])
def test_different_rows_of_small_numbers(columns, base):
    """Also where a row doesn't fit 64 bits."""
    rng = np.random.default_rng(6)
    rows = rng.integers(0, base, (50, columns))[rng.integers(0, 50, 3000)]
    found, counts = kneser_ney._distinct(list(rows.T), base)
    want = sorted(Counter(map(tuple, rows.tolist())).items())
    assert list(zip(zip(*(x.tolist() for x in found), strict=True), counts.tolist(), strict=True)) == want


def test_search_among_cut_keys(tmp_path):
    """Against a dict; keys that agree in 48 bits, others in none, also at both ends."""
    rng = np.random.default_rng(5)
    keys = np.unique(np.r_[rng.integers(1 << 62, 3 << 62, 3000, np.uint64), (rng.integers(1 << 46, 3 << 46, 20, np.uint64)[:, None] << np.uint64(16) | rng.integers(0, 1 << 16, 40, np.uint64)).ravel()])
    out = kneser_ney._Table(f"file://{tmp_path}", "2-0", kneser_ney._COUNT)
    for some in (keys[:1700], keys[1700:]):
        out.add(some, *kneser_ney._split(np.ones(len(some), np.int64)))
    n, shared, apart, begins = out.close()
    assert (n, shared, apart) == (len(keys), 1, 0)
    begin, key, rest = (np.fromfile(f"{tmp_path}/2-0.{c}", k) for c, k in (("begin", np.uint64), ("key", np.uint32), ("rest", np.uint16)))
    assert len(begin) == begins
    at = {k: i for i, k in enumerate(keys.tolist())}
    own = np.r_[keys, keys - np.uint64(1), keys + np.uint64(1), keys ^ np.uint64(1 << 40), rng.integers(0, (1 << 64) - 1, 3000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]
    assert kneser_ney._among_cut(begin, key, rest, own).tolist() == [at.get(k, -1) for k in own.tolist()]


def test_a_table_cut_short_fails(spark):
    """Each of its files."""
    model = kneser_ney.count(spark.createDataFrame([(f"hot w{i}",) for i in range(600) for _ in range(i + 1)], "text string"), order=2)
    folder, (part, n) = kneser_ney._local(model.folder), next((p, n) for (level, p), n in model.sizes.items() if level == 2 and n > 1)
    files = [x for x in os.listdir(folder) if x.startswith(f"2-{part}.")]
    assert {x.split(".")[1] for x in files} == {"begin", "key", "rest", "code", "at", "low", "high"}
    for name in files:
        with open(f"{folder}/{name}", "r+b") as file:
            whole = file.read()
            file.truncate(len(whole) // 2 // 8 * 8)
        keys = np.arange(0, 1 << 64, 1 << 54, dtype=np.uint64)
        with pytest.raises(ValueError, match="rows, not|empty file"):
            kneser_ney._Tables(model).find(2, keys)
        with open(f"{folder}/{name}", "wb") as file:
            file.write(whole)
        assert kneser_ney._Tables(model).find(2, keys).shape == (1, len(keys))


def test_kneser_ney_takes_little_disk(spark):
    """Bytes of the tables and of shuffled blocks for each n-gram, with words as frequent as in a language."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 400) % 50_000) for _ in range(1000)]
    model = kneser_ney.count(spark.createDataFrame([(t,) for t in texts], "text string"))
    n = sum(n for (level, _), n in model.sizes.items() if level > 1)
    folder = kneser_ney._local(model.folder)
    assert sum(os.path.getsize(f"{folder}/{x}") for x in os.listdir(folder) if x[0] in "23") < 11 * n
    blocks = [r for b in kneser_ney._count(3, 4, 1, model)([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]) for r in b.to_pylist()]
    assert sum(len(r["block"]) for r in blocks) < 7 * sum(int.from_bytes(r["block"][:8], "little") for r in blocks)


def test_one_text_of_a_repeated_labelled_id(spark):
    """Many documents under one labelled id are one row of the sample."""
    rows = [(1, f"vile word{i % 3}") for i in range(300)] + [(i, f"plain text number{i}") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 30)], "doc_id long, toxic int")
    sizes = []
    plain = toxicity._first_of_near_copies
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "_first_of_near_copies", lambda rows: sizes.append(rows.count()) or plain(rows))
        toxicity.train(docs, labels)
    assert sizes == [29]


def test_query_counts_all_orders_of_the_operator(spark):
    import inspect

    from tidemark.llm import kneser_ney

    assert kneser_ney.QUERY_ORDER == inspect.signature(kneser_ney.count).parameters["order"].default == 3
