import random

from pyspark.sql import functions as F

from tidemark.functions import geometry, text
from tidemark.operators import journal, log, oplog, records
from tidemark.operators.reducer import Fold, current_records, reduce_mutations
from tidemark.sources.bundles import read_bundle, write_bundle
from tidemark.sources.envelopes import parse_replies


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text_functions(spark):
    t = F.lit("  The CAFÉ—it's   №5!\n")
    row = values(spark, text.canonical_text(t), text.single_line(t), text.bounded_text(t, 5), text.clip_middle(F.lit("a" * 50 + "b" * 50), 40))
    assert row[0] == "the café it s 5"
    assert row[1] == "The CAFÉ—it's №5!"
    assert row[2] == "The C"
    assert len(row[3]) == 40 and row[3].startswith("a") and row[3].endswith("b")
    assert values(spark, text.nfkc(F.lit("ﬁ H₂O Ａ")))[0] == "fi H2O A"


def test_hash_counts_utf16_units(spark):
    def fnv(s, h):
        data = s.encode("utf-16-le")
        for i in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[i : i + 2], "little")) * text.FNV_PRIME) & 0xFFFFFFFF
        return f"{h:08x}"

    for s in ("", "abc", "é中", "a😀b"):
        assert values(spark, text.hash_text(F.lit(s)))[0] == "".join(fnv(s, seed) for seed in text.FNV_SEEDS)


def test_strip_tagged_block(spark):
    for given, left in (("a<x/>b", "ab"), ("a<X y=1>q\nr</x >b", "ab"), ("a<x>never closed", "a"), ("a<xy>b", "a<xy>b"), (None, "")):
        assert values(spark, text.strip_tagged_block(F.lit(given).cast("string"), "x"))[0] == left


def test_geometry(spark):
    got = values(spark, geometry.canonical_direction(F.lit("North-East")), geometry.canonical_direction(F.lit("sw")), geometry.direction_from_delta(F.lit(0.0), F.lit(0.0)), geometry.authority_rank(F.lit("manual"), F.lit(True)), geometry.authority_rank(F.lit("?"), F.lit(False)), *geometry.derive_point(F.lit(0.0), F.lit(0.0), F.lit("up"), F.lit(1.0), 1.0))
    assert list(got) == ["northeast", "southwest", None, 100, 0, None, None]


def test_lineage_handles_long_and_mixed_chats(spark):
    rows = [(c, p, "user" if p % 2 else "assistant", f"t{c}{p}") for c in (1, 2, None) for p in range(300)]
    random.Random(5).shuffle(rows)
    out = log.lineage(spark.createDataFrame(rows, "chat long, pos int, role string, text string")).collect()
    by = {(r.chat, r.pos): r for r in out}
    assert all(by[c, p].parent_key == (by[c, p - 1].lineage_key if p else "root") for c in (1, 2, None) for p in range(300))


def test_undo_restores(spark):
    rnd = random.Random(11)
    for _ in range(3):
        before = {i: rnd.choice("abc") for i in range(40)}
        after = {i: rnd.choice("abc") for i in range(10, 50)}
        b, a = (spark.createDataFrame(list(x.items()), "id long, v string") for x in (before, after))
        assert journal.same_state(journal.apply_undo(a, journal.keyed_undo(b, a, "id"), "id"), b)


def test_similar_records_against_all_pairs(spark):
    rnd = random.Random(3)
    rows = [(i, "k", " ".join(rnd.sample("a b c d e f g h i j k l".split(), rnd.randint(4, 9)))) for i in range(120)]
    got = {(r.left_id, r.right_id) for r in records.similar_records(spark.createDataFrame(rows, "id long, kind string, summary string")).collect()}
    first = {}
    for i, _, s in rows:
        first.setdefault(frozenset(s.split()), i)
    want = {(min(i, j), max(i, j)) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) / len(a | b) >= 0.78}
    assert got == want and want


def test_fold_rules(spark):
    m = lambda ordinal, action, record="r", message=1, **k: {"chat": 1, "record": record, "message": message, "ordinal": ordinal, "lineage": "l", "action": action} | {x: k.get(x) for x in ("kind", "summary", "status", "trend", "time_anchor")}
    rows = [
        m(0, "update", summary="x"), m(1, "create", kind="fact"), m(2, "create", kind="development", summary=" one ", trend="rising"), m(3, "create", kind="fact", summary="again"), m(4, "update", status="resolved"),
        m(5, "update", trend="odd"), m(6, "noop"), m(0, "resolve", message=2), m(1, "update", message=2, summary="late"), m(0, "update", message=3, summary="after"), m(0, "fly", record="q"),
    ]
    schema = "chat long, record string, message long, ordinal long, lineage string, action string, kind string, summary string, status string, trend string, time_anchor string"
    out = reduce_mutations(spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema))
    got = {(r.record, r.message, r.ordinal): r.outcome for r in out.collect()}
    assert [got["r", 1, i] for i in range(7)] == ["no such record", "needs kind and summary", "applied", "record exists", "update can't change status", "applied", "applied"]
    assert (got["r", 2, 0], got["r", 2, 1], got["r", 3, 0], got["q", 1, 0]) == ("applied", "ended in this batch", "applied", "unsupported action")
    last = current_records(out).first()
    assert (last.summary, last.status, last.trend, last.created, last.changed) == ("after", "resolved", None, 1, 3)


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.reducer import reduce_stream

    schema = "chat long, record string, message long, ordinal long, lineage string, action string, kind string, summary string, status string, trend string, time_anchor string"
    rnd = random.Random(2)
    rows = [(c, rnd.choice("ab"), t, 0, "l", rnd.choice(["create", "update", "resolve", "noop"]), "fact", f"s{t}", None, None, None) for t in range(12) for c in (1, 2)]
    for k in range(3):
        spark.createDataFrame(rows[k * 8 : k * 8 + 8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # One file a batch, oldest first.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = reduce_stream(stream).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = reduce_mutations(spark.createDataFrame(rows, schema))
    assert journal.same_state(spark.table("folded"), batch)


def test_fold_needs_message():
    assert Fold().apply({"action": "create", "message": None, "lineage": "l", "summary": "s", "kind": "fact"}) == "needs message and lineage"


def test_oplog(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], "id long, v string, at long")
    b = spark.createDataFrame([(1, "z", 3)], "id long, v string, at long")
    assert {(r.id, r.v) for r in oplog.merge_rows(a, b, ["id"], 10).collect()} == {(1, "z"), (2, "y")}


def test_replies(spark):
    replies = [(1, '```json\n{"mutations": [{"action": "create", "description": "s", "category": "fact", "evidence": [{"sourceMessageId": 0, "claim": "c"}]}, {"action": "update", "evidence": [{"sourceMessageId": 0, "claim": "c"}]}, {"action": "create", "summary": "a", "description": "b", "kind": "fact"}]}\n```'), (2, "no json"), (3, '{"mutations": []}')]
    got = {(r.id, r.ordinal): r.reason for r in parse_replies(spark.createDataFrame(replies, "id long, reply string")).collect()}
    assert got == {(1, 0): None, (1, 1): "needs a record", (1, 2): "conflicting names", (2, -1): "not one object with mutations"}


def test_bundle(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    write_bundle(rows, str(tmp_path), "me", 1)
    assert journal.same_state(read_bundle(spark, str(tmp_path), "me", 1), rows)
    try:
        read_bundle(spark, str(tmp_path), "you", 1)
        raise AssertionError
    except ValueError:
        pass


def test_one_hop_leaves_what_a_full_seed_cant_take(spark):
    from tidemark.operators import records

    seeds = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    edges = spark.createDataFrame([(1, n) for n in (2, 10, 11, 12, 13, 14)] + [(2, n) for n in (1, 10, 11, 13, 14, 15)], "id long, neighbour long")
    found = sorted(map(tuple, records.expand_one_hop(seeds, edges).collect()))
    assert found == [(1, 10), (1, 11), (1, 12), (2, 13), (2, 14), (2, 15)]
