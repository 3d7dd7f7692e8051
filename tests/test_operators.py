"""Hand-computed cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scalars
from folioscope.operators import bow, evaluate, joins, ml, rules_engine, selection
from folioscope.rules import CAPTION_RULES
from folioscope.schemas import LABEL_KEYS


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_positional_join(spark):
    make = lambda pairs: spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "k long, v string, at int")
    a = make([(3, "three"), (5, "five"), (1, "one")])
    b = make([(1, "Eins"), (7, "Sieben"), (3, "Drei"), (2, "Zwei")])
    c = make([(5, "cinque"), (7, "sept")])
    got = rows(joins.positional_join([a, b, c], "k", "v", "at").drop("rn"), "k")
    assert got == [(1, "one", "Eins", None), (2, None, "Zwei", None), (3, "three", "Drei", None), (5, "five", None, "cinque"), (7, None, "Sieben", "sept")]
    twice = joins.positional_join([make([(1, "a1"), (1, "a2")]), make([(1, "b1")])], "k", "v", "at")
    assert rows(twice) == [(1, 1, "a1", "b1"), (1, 2, "a2", None)]


def test_merge_outer(spark):
    a = spark.createDataFrame([("x", "1", 0), ("y", "2", 1), ("x", "9", 2)], "id string, a string, at int")
    b = spark.createDataFrame([("y", "5", 0), ("z", "6", 1)], "id string, b string, at int")
    assert rows(joins.merge_outer([a, b], "at")) == [("x", "1", None), ("y", "2", "5"), ("z", None, "6")]
    assert rows(joins.merge_outer([a, b], "at", complete=True)) == [("y", "2", "5"), ("z", None, "6")]
    with pytest.raises(ValueError):
        joins.merge_outer([a, b.withColumnRenamed("id", "key")], "at")
    with pytest.raises(Exception, match="header in data"):
        joins.merge_outer([a, spark.createDataFrame([("x", "cluster_3", 0)], "id string, b string, at int")], "at").collect()


def test_splits(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    train, test = joins.train_test(df, "id", ids("a"), ids("b", "c"))
    assert rows(train) == [("a", 1)] and rows(test) == [("b", 2), ("c", 3)]
    # Faults are errors of the rows' own plan.
    with pytest.raises(Exception, match="in both lists"):
        joins.train_test(df, "id", ids("a"), ids("a"))[0].collect()
    with pytest.raises(Exception, match="listed but not in the table"):
        joins.keep_ids(df, "id", ids("zz")).collect()
    with pytest.raises(Exception, match="listed but not in the table"):
        joins.keep_ids(df, "id", ids("zz"), drop_key=True).collect()
    assert rows(joins.keep_ids(df, "id", ids("a", "c", "c"), drop_key=True)) == [(1,), (3,)]
    assert rows(joins.split_by_lists(df, "id", ids("a", "b"), ids("b"))) == [("a", 1, "train"), ("b", 2, "train")]


def test_enrich_appends_what_was_fetched(spark):
    known = spark.createDataFrame([("1", ["x"]), ("2", [])], "pmid string, terms array<string>")
    appended = []
    keys = spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string")
    fetch = joins.fetch_with(lambda k: ["new"] if k == "2" else [], "pmid")
    out = joins.enrich(keys, "pmid", known, fetch, lambda df: appended.extend(df.collect()))
    assert rows(out) == [("1", ["x"]), ("2", ["new"]), ("3", None)] and [tuple(r) for r in appended] == [("2", ["new"])]


def test_each_missing_key_is_fetched_once(spark, tmp_path):
    known = spark.createDataFrame([], "pmid string, terms array<string>")

    def call(k):
        with open(tmp_path / f"{k}", "a") as f:
            f.write("x")
        return [k]

    keys = spark.createDataFrame([("1",), ("2",)], "pmid string")
    out = joins.enrich(keys, "pmid", known, joins.fetch_with(call, "pmid"), lambda df: df.count())
    assert rows(out) == [("1", ["1"]), ("2", ["2"])] and [(tmp_path / k).read_text() for k in "12"] == ["x", "x"]


def test_first_and_last_of_a_key(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "y"), (None, 3, "z"), (None, 4, None)], "k string, at int, v string")
    assert rows(joins.first_by(df, ["k"], "at"), "at") == [("a", 1, None), (None, 3, "z")]
    assert rows(joins.last_by(df, ["k"], "at"), "at") == [("a", 2, "y"), (None, 4, None)]


def test_confusion_and_rates(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "A"), ("A", "B"), ("B", "B"), ("B", None)], "gold string, pred string")
    m = evaluate.confusion(df, labels=["A", "B"])
    assert m.count() == 9
    s = {r.label: r for r in evaluate.label_stats(m).collect()}
    assert (s["A"].precision, round(s["A"].recall, 6), round(s["A"].f, 6)) == (1.0, 0.666667, 0.8)
    assert (s["B"].precision, s["B"].recall, s["B"].f) == (0.5, 0.5, 0.5)
    assert evaluate.macro_f(m).first()[0] == pytest.approx(0.65)
    assert evaluate.macro_f(m, compat=True).first()[0] == pytest.approx(1.3 / 3)
    assert evaluate.accuracy(m).first().accuracy == pytest.approx(0.6)
    assert evaluate.accuracy(m.limit(0)).first().total == 0
    assert "A: P=1.000" in evaluate.report(m)
    assert {tuple(r) for r in evaluate.merge(m, m).filter("n > 0").collect()} == {("A", "A", 4), ("A", "B", 2), ("B", "B", 2), ("B", "NONE", 2)}
    lazy = evaluate.confusion(df.withColumn("gold", F.raise_error(F.lit("a row was read")).cast("string")), labels=["A", "B"])
    assert lazy.columns == ["gold", "pred", "n"]  # no job before the action
    with pytest.raises(Exception, match="unknown label"):
        evaluate.confusion(df, labels=["A"]).collect()


def test_counters(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "g boolean, s boolean")
    one = evaluate.binary(df, "g", "s")
    assert tuple(one.first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(evaluate.add_counters(one.unionByName(one)).first())[:4] == (2, 2, 2, 2)


def test_tf_idf_and_lda(spark):
    df = spark.createDataFrame([("i1", 3), ("i1", 3), ("i1", 7), ("i2", 7)], "image string, cluster int")
    got = {(r.image, r.cluster): r.tfidf for r in bow.tf_idf(df, "image", "cluster").collect()}
    assert got == pytest.approx({("i1", 3): 2 / 3 * math.log(3), ("i1", 7): 1 / 3 * math.log(1.5), ("i2", 7): math.log(1.5)})
    l1 = bow.tf_idf(df, "image", "cluster", norm="l1").groupBy("image").agg(F.sum("tfidf").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in l1)
    labels = spark.createDataFrame([("i1", "CT")], "image string, label string")
    assert rows(bow.lda_lines(bow.term_frequency(df, "image", "cluster"), "image", "cluster", labels)) == [("i1", "2 CT 3:2 7:1"), ("i2", "1 ? 7:1")]
    wide = bow.wide(bow.tf_idf(df, "image", "cluster"), "image", "cluster")
    assert wide.columns == ["image", "cluster_3_tfidf", "cluster_7_tfidf"] and wide.filter("image = 'i2'").first()[1] == 0


def test_info_gain(spark):
    df = spark.createDataFrame([(1, 0, "A"), (2, 0, "A"), (0, 0, "B"), (0, 5, "B"), (0, 5, None)], "f1 int, f2 int, label string")
    got = {r.feature: r.gain for r in selection.info_gain(df, ["f1", "f2"], "label").collect()}
    assert got == pytest.approx({"f1": 1.0, "f2": 0.311278}, abs=1e-6)
    assert selection.select_features(df, ["f1", "f2"], "label", 1, per_class=True) == ["f1"]
    with pytest.raises(ValueError):
        selection.top(selection.info_gain(df, ["f1", "f2"], "label"), 3)
    assert selection.ranges([3, 1, 2, 7]) == "1-3,7" and selection.parse_ranges("first,3-last", list("abcd")) == ["a", "c", "d"]
    with pytest.raises(TypeError):
        selection.require_numeric(df, "f1")


def test_rules(spark):
    assert len(CAPTION_RULES) == 118 and {r.label for r in CAPTION_RULES} <= set(LABEL_KEYS)
    captions = ["Axial CT of the lung", "X-ray of the chest", "photo-finish", "a photo", None, "", "3D model", "zzzzzzz", "Western blot, PCR and gel"]
    df = spark.createDataFrame(list(enumerate(captions)), "id int, caption string")
    out = rules_engine.predict(df).withColumn("label", rules_engine.argmax_label(F.col("predictions"), LABEL_KEYS))
    got = {r.id: r for r in out.collect()}
    assert [got[i].label for i in range(9)] == ["CT", "XR", None, "PX", None, None, "3D", None, "GL"]
    assert got[0].predictions["CT"] == pytest.approx(0.92)
    v = df.select(rules_engine.vector(F.col("caption")).alias("v")).collect()
    assert all(len(r.v) == 118 for r in v) and sum(v[4].v) == 0
    assert [r.id for r in rules_engine.unknown(df).collect()] == [2, 7]
    assert len(rules_engine.wide(df, "id", "caption").columns) == 119
    tie = spark.range(1).select(rules_engine.argmax_label(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(1.0)), ["a", "b"]).alias("x"))
    assert tie.first().x == "a"


def test_scalars(spark):
    df = spark.createDataFrame([("/a/b/im.1.jpg", "im:3", "3D", 26)], "path string, key string, text string, n int")
    r = df.select(
        scalars.basename(F.col("path")).alias("base"), scalars.vector_key(F.col("key")).alias("k"), scalars.to_double(F.col("text")).alias("d"), scalars.small_label(F.col("n")).alias("l"),
        scalars.number_text(F.lit(2.0)).alias("t"), scalars.number_text(F.lit(2.5)).alias("t2"), scalars.heading_terms(F.lit("D"), F.array(F.lit("Q1"), F.lit("Q2"))).alias("h"),
        scalars.descriptor_vector(F.lit("tamura 2 1.5 2")).alias("v1"), scalars.descriptor_vector(F.lit("edgehistogram;1;2")).alias("v2"), scalars.descriptor_vector(F.lit("1 2")).alias("v3"),
        scalars.argmax(F.array(F.lit(1.0), F.lit(3.0))).alias("m"), scalars.by_largest(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), scalars.x_log_x(F.lit(0.0)).alias("x"), scalars.to_int(F.lit("12x")).alias("i"),
    ).first()
    assert (r.base, tuple(r.k), r.d, r.l, r.t, r.t2, r.m, r.x, r.i) == ("im.1", ("im", 3), None, "BA", "2", "2.5", 1, 0.0, None)
    assert r.h == ["D", "D:Q1", ":Q1", "D:Q2", ":Q2"] and r.v1 == [1.5, 2.0] and r.v2 == [1.0, 2.0] and r.v3 == [1.0, 2.0] and r.z == [0.0, 0.0]
    with pytest.raises(Exception, match="not a vector key"):
        df.select(scalars.vector_key(F.col("path"))).collect()


def test_precomputed_gate_and_vote(spark):
    labels = [f"l{i}" for i in range(18)]
    t = spark.createDataFrame([("a", "l3")], "id string, label string")
    out = {r.id: r for r in ml.precomputed(spark.createDataFrame([("a",), ("b",)], "id string"), "id", t, labels, 0.7).collect()}
    assert out["a"].distribution[3] == pytest.approx(0.0775194, abs=1e-6) and out["a"].distribution[0] == pytest.approx(0.0542636, abs=1e-6)
    assert sum(out["b"].distribution) == 0 and out["b"].pred is None
    with pytest.raises(Exception, match="not a class"):
        ml.precomputed(t, "id", spark.createDataFrame([("a", "no")], "id string, label string"), labels).collect()
    g = spark.range(1).select(ml.sure_gate(F.array(F.lit(0.1), F.lit(0.9)), ["a", "b"], ["b"]).alias("x"), ml.sure_gate(F.array(F.lit(0.9), F.lit(0.1)), ["a", "b"], ["b"]).alias("y")).first()
    assert g.x == [0.0, 1.0] and g.y == [0.5, 0.5]
    tree = ml.Hierarchy({"r": ["a", "m"], "m": ["b", "c"]}, "r")
    assert tree.leaves() == ["a", "b", "c"] and tree.inner() == ["r", "m"] and tree.branch("r") == {"a": "a", "b": "m", "c": "m"}


def test_folds_have_equal_shares(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4).cast("string").alias("label"))
    n = ml.folds(df, "id", "label", 5).groupBy("fold", "label").count().collect()
    assert len(n) == 20 and {r["count"] for r in n} == {5}
    odd = ml.folds(spark.range(37).select("id", F.when(F.col("id") > 3, "a").alias("label")), "id", "label", 3)
    got = {(r.label, r.fold): r["count"] for r in odd.groupBy("label", "fold").count().collect()}
    assert sorted(v for (l, _), v in got.items() if l == "a") == [11, 11, 11] and sorted(v for (l, _), v in got.items() if l is None) == [1, 1, 2]
