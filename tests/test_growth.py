"""Plans that grow with their input: what stays on the executors, and what is worked out once for equal rows."""

from pyspark.sql import functions as F

from tidemark.operators import consolidation


def _broadcasts(df) -> int:
    """Of a run whose shuffle files are small enough for broadcasts."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastExchange")


def _statements(spark, n: int = 60):
    k = F.col("id")
    said = F.concat(F.lit("the old gate "), (k % 10).cast("string"), F.lit(" of the north"))
    return spark.range(n).select("id", F.lit("fact").alias("kind"), F.when(k % 3 == 0, "resolved").otherwise("active").alias("status"), said.alias("summary"), F.array(F.concat(F.lit("Gate "), (k % 10).cast("string"))).alias("anchors"))


def test_pools_are_counted_without_broadcasts(spark):
    own = _statements(spark)
    counts = consolidation.pool_counts(own.filter("id < 30"), own)
    assert _broadcasts(counts) == 0
    want = consolidation.pool(own.filter("id < 30"), own).groupBy("candidate_id").agg(F.sum("n").alias("n"), F.min("id").alias("first_id"))
    assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in want.collect()} and counts.count() == 30


def test_decisions_without_broadcasts(spark):
    own = _statements(spark)
    new = own.select(F.col("id") + 100, F.when(F.col("id") % 2 == 0, F.col("kind")).alias("kind"), "summary", "anchors").toDF("id", "kind", "summary", "anchors")
    found = consolidation.decide(new, own)
    assert _broadcasts(found) == 0
    rows = {r.candidate_id: r.decision for r in found.collect()}
    assert len(rows) == 60 and all(rows[100 + k] == ("update" if k % 2 == 0 else "create") for k in range(60))


def test_statements_with_other_anchors_do_not_meet_by_words(spark):
    n, k = 300, F.col("id")
    own = spark.range(n).select("id", F.lit("fact").alias("kind"), F.lit("active").alias("status"), F.concat(F.lit("the old gate of the north "), k.cast("string")).alias("summary"), F.array(F.concat(F.lit("Gate "), k.cast("string")), F.lit("x")).alias("anchors"))
    bare = spark.createDataFrame([(n, "fact", "active", "the old gate of the north", [])], own.schema)
    found = consolidation.alike(own.unionByName(bare), own.unionByName(bare))
    assert {(r.summary, r.id) for r in found.collect()} == {(f"the old gate of the north {i}", j) for i in range(n) for j in (i, n)} | {("the old gate of the north", j) for j in range(n + 1)}
    assert _most_rows(found._jdf.queryExecution().executedPlan()) <= 20 * n


def _rows_of_joins(plan) -> list[int]:
    """Rows that the joins of a plan made, those nearest to its root first."""
    name = plan.getClass().getSimpleName()
    own = [plan.metrics().get("numOutputRows").get().value()] if name.endswith("JoinExec") else []
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
    return own + [x for p in below for x in _rows_of_joins(p)]


def test_whole_sets_are_fetched_for_similar_ones_only(spark):
    from tidemark.operators import records

    # Eight words of all, which are the rarest that any two share, and two sets that are alike.
    told = [" ".join([f"r{k}" for k in range(8)] + [f"w{(i * 37 + k * k) % 400}" for k in range(100)]) for i in range(40)] + ["old mill by the river", "old mill by the river again"]
    own = spark.createDataFrame([(i, "fact", x) for i, x in enumerate(told)], "id long, kind string, summary string")
    found = records.similar_records(own, 0.7)
    assert [tuple(r)[:2] for r in found.collect()] == [(40, 41)]
    assert _rows_of_joins(found._jdf.queryExecution().executedPlan())[:2] == [1, 1]


def test_similar_records_some_at_a_time(spark, monkeypatch):
    """Words are numbered and pairs counted in parts, with copies and with words of one set, as all pairs have it."""
    import random

    from tidemark.operators import records

    rng = random.Random(5)
    told = [" ".join(rng.sample("a b c d e f g h i j k l".split(), rng.randint(3, 9)) + ([f"only{i}"] if rng.random() < 0.3 else [])) for i in range(80)]
    told += [" ".join(reversed(x.split())) for x in told[:20]] + ["", "one", "one"]
    own = spark.createDataFrame([(i, rng.choice(("fact", None)), x) for i, x in enumerate(told)], "id long, kind string, summary string")
    firsts = {}
    for r in own.collect():
        if r.summary:
            firsts.setdefault((r.kind or "", frozenset(r.summary.split())), r.id)
    want = {(i, j): len(a & b) / len(a | b) for (k, a), i in firsts.items() for (m, b), j in firsts.items() if i < j and k == m and len(a & b) / len(a | b) >= 0.7}
    cuts = []
    real = records.cut
    monkeypatch.setattr(records, "cut", lambda df: (cuts.append(df), real(df))[1])
    n = []
    for some, met in ((10**9, 10**9), (100, 10**9), (100, 1)):
        cuts.clear()
        monkeypatch.setattr(records, "WORDS", some)
        monkeypatch.setattr(records, "MET", met)
        assert {(r.left_id, r.right_id): r.similarity for r in records.similar_records(own, 0.7).collect()} == want and len(want) > 9
        n.append(len(cuts))
    assert n[0] == 2 < n[1] < n[2]


def test_whole_sets_do_not_travel(spark, monkeypatch):
    """What is shuffled of a set's words is rows of a word and then numbers, not the set itself."""
    from tidemark.operators import records

    plans = []
    real = records.cut
    monkeypatch.setattr(records, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    own = spark.createDataFrame([(1, "fact", "old mill by the river"), (2, "fact", "old mill by the river again")], "id long, kind string, summary string")
    assert [tuple(r)[:2] for r in records.similar_records(own).collect()] == [(1, 2)]
    assert not any("Exchange hashpartitioning(kind" in line and "own#" in line for x in plans for line in x.splitlines())


def test_places_of_a_name_share_its_mentions(spark):
    from tidemark.operators import views

    n = 3000
    places = spark.range(n).select("id", F.lit("old mill").alias("name"))
    records = spark.range(n).select("id", F.lit("active").alias("status"), F.col("id").alias("changed"), F.lit("by the old mill").alias("summary"), F.array().cast("array<string>").alias("anchors"))
    found = views.place_mentions(places, records)
    rows = found.groupBy("place_id").agg(F.count("*").alias("k"), F.min("id").alias("low"), F.min("total").alias("total")).collect()
    assert len(rows) == n and {(r.k, r.low, r.total) for r in rows} == {(6, n - 6, n)}
    sent = found._jdf.queryExecution().executedPlan()
    assert _most_rows(sent) <= 6 * n


def _most_rows(plan) -> int:
    """The most rows that any step of a plan that ran made."""
    own = [plan.metrics().get("numOutputRows").get().value()] if plan.metrics().contains("numOutputRows") else []
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    return max([*own, *map(_most_rows, below), 0])


def test_episodes_of_copies_are_counted_by_statement(spark):
    own = _statements(spark).unionByName(_statements(spark).withColumn("id", F.col("id") + 1000)).withColumn("anchors", F.array(F.lit("North Gate"), F.lit("x")))
    new = own.filter("id % 7 = 1").unionByName(own.limit(1).withColumn("kind", F.lit("rumour")))
    counts = consolidation.episode_counts(new, own)
    left = new.toDF("candidate_id", "kind", "status", "s", "a").drop("status")
    score = F.round(consolidation.similarity(F.col("s"), F.col("summary"), F.col("a"), F.col("anchors")), 9)
    fits = lambda b: F.count_if(consolidation.new_episode_related(score, F.col("s"), F.col("summary"), F.col("a"), F.col("anchors"), 0.55, b))
    want = left.join(own, "kind").groupBy("candidate_id").agg(fits(False).alias("related"), fits(True).alias("beyond"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))


def _seconds(make) -> float:
    import time

    began = time.time()
    make().write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_phrases_of_a_long_text_are_linear(spark):
    from tidemark.functions import lexical, text

    own = spark.createDataFrame([(" ".join(f"w{i}" for i in range(6000)),)] * 2, "text string")
    lists = own.select(lexical.phrase_candidates(F.col("text")).alias("p"))
    assert _seconds(lambda: lists) < 8 and [len(r.p) for r in lists.collect()] == [384, 384]


def test_phrases_of_a_long_text_are_counted_in_linear_time(spark):
    from tidemark.functions import text

    own = spark.createDataFrame([(" ".join(f"w{i}" for i in range(6000)),)] * 2, "text string")
    counts = own.select(F.size(text.phrases(text.canonical_text(F.col("text")))).alias("n"))
    assert _seconds(lambda: counts) < 8 and {r.n for r in counts.collect()} == {6 * 6000 - 15}


def test_excerpts_end_where_the_text_does_not_a_line(spark):
    from tidemark.functions import lexical

    head = "a " * 50 + "b" * 19 + "\n"
    rows = spark.createDataFrame([(head + "next words follow",), ("x" * 119 + "\nnext",)], "text string").select(lexical.bounded_excerpt(F.col("text"), 120).alias("e")).collect()
    assert [r.e for r in rows] == [head, "x" * 119 + "\n"]


def test_claims_are_read_once(spark):
    """A claim is stated by several sentences of a text: its canonical form isn't worked out again at each."""
    from tidemark.operators import admission

    text = " ".join(["The scout reports that the old bridge fell at dawn."] * 300)
    rows = spark.range(40).select("id", F.lit("the old bridge fell at dawn").alias("claim"), F.lit(text).alias("text"), F.lit("").alias("focus"))
    found = admission.evidence_status(rows)
    took = _seconds(lambda: found)
    assert took < 30 and {(r.reported, r.attributed) for r in found.collect()} == {(True, True)}, took


def test_proposals_meet_records_without_broadcasts(spark):
    from tidemark.plans import speech

    assert _broadcasts(speech.admission_gate(spark, "/root/testdata/sf0.001")) == 0


def _broadcast_rounds(monkeypatch, module, make) -> int:
    """Broadcasts in the plans that a function's rounds cut."""
    from tidemark.operators import shared

    n = []

    def cut(df):
        df.collect()
        n.append(_broadcasts(df))
        return shared.cut(df)

    monkeypatch.setattr(module, "cut", cut)
    make()
    return sum(n)


def test_causes_close_without_broadcasts(spark, monkeypatch):
    from tidemark.operators import derived

    rows = spark.range(1, 40).select("id", F.array(F.floor(F.col("id") / 2)).alias("caused_by")).filter("id > 1")
    assert _broadcast_rounds(monkeypatch, derived, lambda: derived.all_causes(rows).count()) == 0


def test_known_points_are_not_broadcast(spark, monkeypatch):
    from tidemark.operators import derivation, shared

    monkeypatch.setattr(shared, "FEW", 0)
    k = F.col("id")
    at = F.when(k < 1, 0.0)
    places = spark.range(40).select("id", at.alias("x"), at.alias("y"), F.lit("base_canonical").alias("authority"), F.lit(False).alias("locked"))
    relations = spark.range(1, 40).select(F.floor(k / 3).cast("long").alias("from"), k.alias("to"), F.lit("north").alias("direction"), F.lit(1.0).alias("km"))
    found = []
    assert _broadcast_rounds(monkeypatch, derivation, lambda: found.extend(derivation.derived_points(places, relations).collect())) == 0
    assert len(found) == 40 and max(r.depth for r in found) == 4


def test_records_are_folded_batch_by_batch(spark):
    """Each batch of rows is passed on when the next one is there, also where a record goes on in it; what a fold doesn't read stays as it is."""
    import pyarrow as pa

    from tidemark.operators import transactions as tx

    kind = f"chat long, {tx.MUTATION}, outcome string"
    given, out = tx._arrow(spark, f"{kind}, begun {tx._STRUCT}"), tx._arrow(spark, f"chat long, batch long, ordinal long, message long, lineage string, action string, record string, related array<string>, evidence {tx._EVIDENCE}, outcome string, fields {tx._STRUCT}")
    said = [{"chat": 1, "batch": k, "ordinal": k, "message": k, "action": "update" if k else "create", "record": "a", "kind": "fact", "summary": f"s{k}", "related": ["b"], "evidence": [{"claim": f"c{k}"}]} for k in range(3)]
    said += [{"chat": 1, "batch": 3, "ordinal": 3, "message": 3, "action": "update", "record": "b"}]
    found = list(tx._folded((pa.RecordBatch.from_pylist([x], given) for x in said), out))
    rows = [r for b in found for r in b.to_pylist()]
    assert [b.num_rows for b in found] == [1] * 4 and [r["outcome"] for r in rows] == ["applied"] * 3 + ["no such record"]
    assert [r["evidence"] and r["evidence"][0]["claim"] for r in rows] == ["c0", "c1", "c2", None]
    assert [r["fields"] and (r["fields"]["summary"], r["fields"]["created"], r["fields"]["changed"]) for r in rows] == [None, None, ("s2", 0, 2), None]
