import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import integrity, joins, reads, textindex


@pytest.mark.parametrize("most", [1, 7, 1024])
def test_pairs_in_blocks_are_all_pairs(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), i if rng.random() < 0.9 else i - 1) for i in range(80)]
    got = joins.pairs_within(spark.createDataFrame(rows, "k string, v string, id int"), ["k", "v"], "id", most).select("k", "v", "a.id", F.col("b.id").alias("o")).collect()
    want = sorted((p[0], p[1], p[2], q[2]) for p in rows for q in rows if p[1] is not None and p[:2] == q[:2] and p[2] < q[2])
    assert sorted(map(tuple, got)) == want


def values(spark, n, evidence):
    return spark.range(n, numPartitions=8).select(
        F.lit(0).alias("case_id"), F.lit("email").alias("field"), F.lit("hot").alias("value"), F.col("id").alias("record_id"), (F.col("id") % evidence).alias("evidence_id")
    )


def test_a_value_of_100_000_holders_as_a_class(spark):
    r = joins.value_classes(values(spark, 100_000, 50_000)).first()
    assert (r.records, r.evidence, r.pairs) == (100_000, 50_000, 100_000 * 99_999 // 2 - 50_000)


def test_a_hot_value_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        spread = joins.pairs_within(values(spark, 3_000, 3_000), ["case_id", "field", "value"], "record_id", 256).withColumn("p", F.spark_partition_id())
        per = [r["count"] for r in spread.groupBy("p").count().collect()]
        assert sum(per) == 3_000 * 2_999 // 2 and len(per) >= 4 and max(per) < 0.25 * sum(per)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_terms_in_names(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc1") for _ in range(n))
    names = [(i, word(rng.randrange(9))) for i in range(150)]
    terms = sorted({word(rng.randrange(1, 6)) for _ in range(1_500)})
    df = spark.createDataFrame(names, "id int, t string")
    found = textindex.containing(df, spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted((r.id, r.term) for r in found.collect()) == sorted((i, t) for i, n in names for t in terms if t in n)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_grams_of_texts_are_not_broadcast(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.lower("c_name").alias("t"))
    found = textindex.containing(names, names.select(F.right("t", F.lit(4)).alias("term")).distinct())
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_siblings_of_one_id_fill_in_any_order(spark):
    rows = spark.createDataFrame([(1, 5.0, 1, False, None)], "evidence_id int, amount double, id int, reviewed boolean, sender int")
    two = [(1, 5.0, 7, 30), (1, 5.01, 7, 20), (1, 5.0, 7, None), (1, 5.0, 8, 10)]
    for order in (two, two[::-1]):
        siblings = spark.createDataFrame(order, "evidence_id int, amount double, id int, sender int").coalesce(1)
        assert [r.sender for r in joins.fill_sibling(rows, siblings, ["sender"]).collect()] == [20]


def test_patterns_with_and_without_an_index(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("aBc_%d") for _ in range(rng.randrange(12))), rng.choice([None, "xyz abc", "Q"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    index = textindex.build(df, "id", ["a", "b"])
    for pattern in ("%abc%", "%ab_cd%", "%Z a%", "%a%", "%__%", "%bcd%abc%", "%nope%"):
        plain, fast = (sorted(r.id for r in textindex.matching(df, "id", ["a", "b"], pattern, x).collect()) for x in (None, index))
        assert plain == fast


def test_any_number_of_terms(spark):
    names = spark.range(300).select("id", F.concat(F.lit("Name #"), F.col("id").cast("string")).alias("label"))
    terms = spark.range(1_300).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("term"))
    got = {r.term: (r.id, r.exact) for r in reads.match(names, terms).collect()}
    assert len(got) == 1_300 and got["name 7"] == (7, True) and got["name 999"] == (None, False)


def test_json_texts(spark):
    import json

    texts = ["", "plain ASCII ~", 'quote " and \\', "line\n", "end\n", "tab\t\r\b\f", "é漢\U0001f600", "\x00\x1f\x7f", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", integrity.json_text(F.col("t")).alias("j")).collect()
    assert [r.j for r in sorted(got, key=lambda r: r.i)] == [json.dumps(t) for t in texts]


def test_prior_records_are_ranked_before_they_meet_entities(spark):
    """Ranks of one and of several rows of an entity, and no sort over the pairs."""
    from caseweave.operators import joins

    e = spark.createDataFrame([(1, "phone", "a"), (2, "phone", "a"), (3, "phone", "a"), (3, "email", "b"), (4, "phone", None)], "entity_id int, entity_type string, key string")
    rows = [("phone", "a", "x", "2020-01-02"), ("phone", "a", "y", None), ("phone", "a", "w", "2020-01-02"), ("email", "b", "z", "2021-01-01")]
    p = spark.createDataFrame(rows, "identifier_type string, identifier_value string, record_reference string, registered_on string")
    out = joins.prior_records(e, p)
    got = sorted((r.entity_id, r["rank"], r.record_reference) for r in out.collect())
    assert got == [(1, 1, "y"), (1, 2, "w"), (1, 3, "x"), (2, 1, "y"), (2, 2, "w"), (2, 3, "x"), (3, 1, "y"), (3, 2, "z"), (3, 3, "w"), (3, 4, "x")]
    # the records' own ranks are among the windows: by their value, not by the entity
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(identifier_type" in plan


def test_connections_and_edges_are_summed_in_given_parts(spark):
    """Both ends, relations to oneself and to none, repeated and missing evidence; the number of tasks is the caller's."""
    from caseweave.operators import graph

    rows = [(1, "a", "b", "e1", 0.5, "X", "ok"), (1, "b", "a", "e1", 0.9, "Y", "ok"), (1, "a", "b", "e2", 0.1, "X", "ok"), (1, "a", "b", None, 0.2, "X", "ok"), (1, "c", "c", "e3", 0.4, "X", "ok"), (1, "a", None, "e4", 0.3, "X", "ok")]
    r = spark.createDataFrame(rows, "case_id int, subject string, object string, evidence_id string, confidence double, relation_type string, status string")
    for n in (None, 3):
        got = sorted(((r.node or "", r.other or "", r.confidence, r.observations, r.n_evidence) for r in graph.profile_connections(r, n).collect()))
        assert got == [("", "a", 0.3, 1, 1), ("a", "", 0.3, 1, 1), ("a", "b", 0.9, 4, 2), ("b", "a", 0.9, 4, 2), ("c", "c", 0.4, 2, 1)]
        assert [tuple(x)[:7] for x in graph.build_edges(r, parts=n).collect()] == [(1, "a", "b", 0.9, 4, 2, "X,Y")]
    assert graph.build_edges(r, parts=7).rdd.getNumPartitions() == graph.profile_connections(r, 7).rdd.getNumPartitions() == 7


def test_extractions_of_a_sentence_are_made_once(spark):
    from caseweave.operators import facts, records

    text = "Accused Ravi Rao was seen near Linking Road. Nobody was seen.\nWitness Asha Kumar was driving MH12AB1234."
    units = spark.createDataFrame([(1, 10, text), (1, 11, None), (2, 12, "Accused Ravi Rao was seen near Linking Road.")], "evidence_id int, unit_id int, text string")
    links = records.person_location_links(units)
    assert sorted((r.unit_id, r.a, r.b) for r in links.collect()) == [(10, "Ravi Rao", "Linking Road"), (12, "Ravi Rao", "Linking Road")]
    plans = [links, facts.report_enrichment(units.select("evidence_id", "text"), units)]
    for plan in (df._jdf.queryExecution().optimizedPlan().toString() for df in plans):
        assert not [x for x in plan.split("\n") if "Filter " in x and "regexp_extract" in x]
