"""Each stage of the pipeline on its own input, against brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_text_ops import _components, _contaminated, _fingerprint

from tidemark.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input of each stage, and the result."""
    at, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"{at}/{name}".replace(" ", "-"))
        docs = spark.read.parquet(f"{at}/{name}".replace(" ", "-"))
    return [*out, docs]


def _rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_return_the_columns_of_documents(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "tokens"]


def test_toxic_documents_go(spark, steps):
    scores = {r.id: r.score for r in toxicity.score(steps[0], toxicity.fitted(spark, steps[0], SF)).collect()}
    assert _rows(steps[1]) == Counter((r.doc_id, r.text) for r in steps[0].collect() if scores[r.doc_id] < 0.5)
    assert steps[1].count() >= 0.8 * steps[0].count()


def test_repeated_lines_go(steps):
    rows = [(r.doc_id, (r.text or "").split("\n")) for r in steps[1].collect()]
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
    having = defaultdict(set)
    for i, lines in rows:
        for line in lines:
            having[key(line)].add(i)
    stays = lambda i, k: len(k) < 40 or len(having[k]) < 5 or max(having[k]) == i
    assert _rows(steps[2]) == Counter((i, "\n".join(x for x in lines if stays(i, key(x)))) for i, lines in rows)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, _fingerprint(r.text)) for r in steps[2].collect()]
    group = {i: root for i, _, root in _components(rows)}
    kept = Counter(group[repr(r.doc_id)] for r in steps[3].collect())
    assert set(kept) == set(group.values()) and set(kept.values()) == {1}


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _rows(steps[4]) == Counter((r.doc_id, r.text) for r in steps[3].collect() if not _contaminated(r.text, items)[1])


def test_tokens(steps):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    known, texts = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={}), {r.doc_id: r.text or "" for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert list(r.ids) == known.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_all_stages(spark, steps):
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r.doc_id, r.ids_sha256) for r in steps[5].collect())


def test_odd_documents(spark):
    rows = [(1, "", "en", "s", 0), (None, None, None, None, None), (1, "", "en", "s", 0), (2, "some text", "en", "s", 9), (2, "other words here now", "en", "s", 20), (None, "z " * 9000, "de", "s", 18000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            done = stage(spark, given, SF)
            assert done.count() <= given.count()
            given = given.sparkSession.createDataFrame(done.collect(), done.schema)


def test_every_column_comes_through_whatever_its_name(spark):
    """Names that the operators use themselves, and one with a dot."""
    names = ["n_lines", "n_dropped", "keep", "mark", "score", "key", "doc", "row", "id", "__row", "__keep", "component_id", "n_hit", "kept_text", "a.b"]
    rows = [(i, f"text number {i} of some words that differ {'much ' * i}", "en", "s", 1, *range(100 * i, 100 * i + len(names))) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, given, SF)
        assert done.columns == docs.columns, name
        kept = {r.doc_id: r for r in done.collect()}
        assert kept and all(kept[i][c] == 100 * i + k for i in kept for k, c in enumerate(names)), name
        given = spark.createDataFrame(list(kept.values()), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, given, SF).count() == given.count()
