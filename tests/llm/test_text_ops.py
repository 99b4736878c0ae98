"""BPE, decontamination, SimHash, line dedup: against brute force, SQL and odd rows."""

import base64
import hashlib
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, simhash

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "\n\n", "it's  a test\t\n x", "é è 漢字 🙂 z", "same text again", "same text again", "word " * 5000, "x" * 3000, "<|endoftext|> 12345 '' \r\n  end  "]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, a repeated id, and columns whose names clash with those used within."""
    rows = [(i if i != 3 else None, t, "x", 1, "y", 2) for i, t in enumerate(ODD)] + [(0, "another text of id 0", "x", 1, "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_words int, hits string, row int")


@pytest.fixture(scope="module")
def tik():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_that_of_tiktoken(spark, tik):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op1_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_rows(odd, tik):
    done = bpe.encode(odd, *bpe.default_tokenizer(), decoded=True).collect()
    assert sorted((list(r.ids), bytes(r.decoded)) for r in done) == sorted((tik.encode_ordinary(t or ""), (t or "").encode()) for t in [*ODD, "another text of id 0"])
    again = bpe.decode(bpe.encode(odd, *bpe.default_tokenizer()), *bpe.default_tokenizer()).collect()
    assert all(bytes(r.decoded).decode() == tik.decode(list(r.ids)) for r in again)
    assert bpe.encode(odd.limit(0), *bpe.default_tokenizer()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t'é漢 s1.", max_size=40))
def test_bpe_of_any_text(tik, text):
    known = bpe.vocabulary(*bpe.default_tokenizer())
    assert known.encode(text) == tik.encode_ordinary(text)


def _words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def _contaminated(text, items):
    """Brute force: (words, words hit, items)."""
    words, hit, named = _words(text), set(), set()
    for item, other in items:
        own = _words(other)
        k = min(10, len(own))
        for at in range(len(own) - k + 1 if own else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[at : at + k]:
                    hit |= {*range(i, i + k)}
                    if item is not None:
                        named.add(str(item))
    return len(words), len(hit), sorted(named)


def test_decontamination_matches_sql(spark, same):
    assert same(decontaminate.op3_decontaminate(spark, SF), decontaminate.ORACLE, SF)


def test_decontamination_of_odd_rows(spark, odd):
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long), (2, "Same TEXT-again"), (3, None), (4, ""), (5, "word word"), (None, "another text of"), (1, long), (7, "é è"), (8, "word " * 12)]
    more = [(100, f"before {long} after"), (101, " ".join(long.split()[:9])), (102, long.upper() + " " + long), (103, " ".join(long.split()[3:13]))]
    docs = odd.select("doc_id", "text", "row", "hits").unionByName(spark.createDataFrame(more, "doc_id long, text string").select("*", F.lit(1).alias("row"), F.lit("").alias("hits")))
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id int, text string").withColumn("window", F.lit(1))).collect()
    want = [_contaminated(r.text, items) for r in docs.collect()]
    assert sorted((r.n_words, r.n_hit, list(r["items"])) for r in found) == sorted(want)
    assert [r.n_hit for r in decontaminate.contamination(docs, spark.createDataFrame([], "item_id int, text string")).collect()] == [0] * len(want)
    assert decontaminate.contamination(docs.limit(0), spark.createDataFrame(items, "item_id int, text string")).count() == 0


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows):
    """Brute force over all pairs: [(id, fingerprint)] to ids and fingerprints with the smallest id reachable."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (own, _) in enumerate(rows):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return sorted((repr(own), f"{fp:016x}", repr(least.get(find(i)))) for i, (own, fp) in enumerate(rows))


def _digests(df):
    return sorted((repr(r.id), f"{r.fp & (2**64 - 1):016x}", repr(r.component_id)) for r in df.collect())


def test_simhash_is_that_of_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = simhash.op5_simhash(spark, SF).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in found) == _components([(r.doc_id, _fingerprint(r.text)) for r in docs])


def test_simhash_of_odd_rows(odd):
    assert _digests(simhash.near_duplicates(odd)) == _components([(r.doc_id, _fingerprint(r.text)) for r in odd.collect()])
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_survive_large_cells_and_chains(spark, monkeypatch):
    """Chains of fingerprints, and cells dealt over block pairs."""
    import random

    rng, fps = random.Random(5), {0, 2**64 - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    near = [0] + [1 << b for b in range(64)] + [3 << b for b in range(62)]
    rows = [(i, x) for i, x in enumerate(sorted(fps | {*near}))]
    signed = [(x - 2**64 if x >= 2**63 else x,) for _, x in rows]
    monkeypatch.setattr(simhash, "CELL_ROWS", 16)
    df = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for (i, _), (fp,) in zip(rows, signed, strict=True):
        groups.setdefault(roots.get(fp, fp), []).append(i)
    want = {}
    for own, _, root in _components(rows):
        want.setdefault(root, []).append(int(own))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_line_dedup_matches_sql(spark, same):
    assert same(line_dedup.op7_line_dedup(spark, SF), line_dedup.ORACLE, SF)


def test_line_dedup_of_odd_rows(spark):
    line, wide, short = "A common line of well over forty characters, it is.", "é" * 39 + "x", "é" * 39
    texts = [f"{line}\nown {i}\n  {line.upper()}\t\n{wide}\n{short}" for i in range(6)] + ["", None, line, f"{line}\n"]
    rows = [(i if i != 2 else None, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, "id 0 again\n" + line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "mark": F.lit("m"), "n_lines": F.lit("z")})
    ids = lambda key: [(-(2**63) if i is None else i) for i, t in rows if any(line_dedup.line_keys(x.encode()) == key for x in (t or "").split("\n"))]
    want = []
    for i, t in rows:
        own, kept = -(2**63) if i is None else i, []
        for x in (t or "").split("\n"):
            key = line_dedup.line_keys(x.encode())
            having = ids(key)
            if len(key.decode()) < 40 or len(set(having)) < 5 or max(having) == own:
                kept.append(x)
        want.append((repr(i), len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    done = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs))
    assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in done.collect()) == sorted(want)
    assert line_dedup.line_keep_bitmaps(docs.limit(0)).count() == 0


def test_a_line_over_many_tasks(spark):
    """One line in every document: its run goes over all partitions."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("this very common line is in every document of all\nown line "), "id").alias("text"))
    done = line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs))
    assert [r.doc_id for r in done.filter("n_dropped = 0").collect()] == [2999]
    assert done.count() == 3000


def test_lines_of_ids_that_are_no_integers_and_clashing_columns(spark):
    line = "a line of more than forty characters, which all of them have"
    rows = [(str(i) if i else "abc", f"{line}\nown {i}", 777, 5, "k", "r", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_lines int, mark int, keep string, row string, __id int")
    found = {r.doc_id: r for r in line_dedup.apply_keep_bitmaps(docs, line_dedup.line_keep_bitmaps(docs)).collect()}
    assert {i: r.n_dropped for i, r in found.items()} == {"abc": 1, "1": 1, "2": 1, "3": 1, "4": 1, "5": 0}
    assert all((r.n_lines, r.mark, r.keep, r.row) == (2, 5, "k", "r") for r in found.values())
    assert found["abc"].kept_text == "own 0" and found["5"].kept_text == f"{line}\nown 5"
