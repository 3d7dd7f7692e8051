"""Learners, hierarchies, logs and scoring on small separable data."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import images, ml
from folioscope.schemas import LABELS
from folioscope.sources import files, sinks


@pytest.fixture(scope="module")
def three(spark):
    """Three classes around the corners of a triangle."""
    draw = np.random.default_rng(7)
    rows = [(i, float(x + draw.normal(0, 0.3)), float(y + draw.normal(0, 0.3)), name) for i, (x, y, name) in enumerate([(0, 0, "a"), (4, 0, "b"), (0, 4, "c")] * 30)]
    return spark.createDataFrame(rows, "id long, x double, y double, label string").coalesce(1)


@pytest.mark.parametrize("fit", [ml.svm(iterations=5), ml.logistic(iterations=10), ml.pairwise_svm(iterations=5), ml.tree(), ml.forest(10), ml.bayes(), ml.boosting(3)], ids=["svm", "logistic", "pairwise", "tree", "forest", "bayes", "boosting"])
def test_learners_tell_classes_apart(three, fit):
    out = ml.evaluate_split(three.filter("id % 2 = 0"), three.filter("id % 2 = 1"), ["x", "y"], "label", fit)
    assert out.columns == ["id", "x", "y", "label", "distribution", "pred"]
    got = out.collect()
    assert len(got) == 45 and sum(r.pred == r.label for r in got) >= 43
    assert all(abs(sum(r.distribution) - 1) < 1e-6 and len(r.distribution) == 3 for r in got)


def test_votes_of_pairs(three):
    score = ml.pairwise_svm(iterations=5)(three, ["x", "y"], "label")
    assert score.labels == ["a", "b", "c"]
    first = score(three.filter("id = 0")).first()
    assert max(first.distribution) == pytest.approx(2 / 3) and first.pred == "a"  # a class takes part in two of three pairs


def test_products_of_features_part_a_cross(spark):
    """Signs that agree against signs that don't: no line parts them, the product does."""
    rows = [(i, float(x), float(y), "same" if x * y > 0 else "other") for i, (x, y) in enumerate((x, y) for x in (-3, -2, 2, 3) for y in (-3, -2, 2, 3))]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string").coalesce(1)
    right = lambda degree: ml.evaluate_split(df, df, ["x", "y"], "label", ml.pairwise_svm(degree=degree)).filter("pred = label").count()
    assert right(2) == 16 > right(1)


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 0.7, "a")], "id long, x double, label string")
    assert [(r.pred, r.distribution) for r in ml.pairwise_svm(iterations=5)(df, ["x"], "label")(df).collect()] == [("a", [1.0])] * 2


def test_hierarchy_of_the_label_dimension(three):
    tree = ml.Hierarchy.of_groups([(code, group) for _, code, group in LABELS])
    assert set(tree.leaves()) == {code for _, code, _ in LABELS if code} and None not in tree.leaves()
    assert tree.branch("ROOT")["PX"] == "PHOTOGRAPH"
    own = ml.Hierarchy.of_groups([("a", "left"), ("b", "left"), ("c", "right"), ("x", "right"), (None, "empty")])
    assert own.children == {"ROOT": ["left", "right"], "left": ["a", "b"], "right": ["c", "x"]}
    two = ml.Hierarchy({"ROOT": ["left", "c"], "left": ["a", "b"]}, "ROOT")
    assert ml.hierarchical(two, ml.pairwise_svm(iterations=5))(three, ["x", "y"], "label")(three).filter("pred = label").count() >= 88


def test_log_of_a_validation(three):
    scored = ml.cross_validate(three, "id", ["x", "y"], "label", ml.tree(), k=3)
    lines = {r.line for r in sinks.validation_lines(scored, "id", ["a", "b", "c"]).collect()}
    assert len(lines) == 90
    row = scored.first()
    n = {"a": 1, "b": 2, "c": 3}
    assert f"{row.fold}\t{n[row.gold]}:{row.gold}\t{n[row.pred]}:{row.pred}\t{'' if row.gold == row.pred else '+'}\t({row.id})" in lines


def test_support_vectors_of_all_folds_are_trained_side_by_side(spark, three):
    """Every row once, whatever its features' scale, without a job for each step of each model."""
    one = spark.createDataFrame([(1000, 9.0, 9.0, "once")], three.schema)  # a class that its own fold's models can't know
    wide = three.filter("id < 60").unionByName(one).withColumn("y", F.col("y") * 1e4 + 1e6).withColumn("flat", F.lit(3.0))
    spark.sparkContext.setJobGroup("folds", "folds")
    try:
        got = ml.cross_validate(wide, "id", ["x", "y", "flat"], "label", ml.svm(iterations=5), k=2).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds"))
    finally:
        spark.sparkContext.setJobGroup("other", "other")
    assert got[0].asDict().keys() == {"id", "fold", "gold", "pred"} and len(got) == 61 and jobs < 60
    assert sum(r.pred == r.gold for r in got) >= 58 and next(r.pred for r in got if r.id == 1000) != "once"
    whole = ml.cross_validate(three.withColumn("label", F.lit(7)).filter("id < 9"), "id", ["x"], "label", ml.svm(iterations=5), k=20).collect()
    assert len(whole) == 9 and {(r.gold, r.pred) for r in whole} == {(7, "7")}
    with pytest.raises(Exception, match="not finite"):
        ml.cross_validate(three.withColumn("x", F.when(F.col("id") > 0, F.col("x"))), "id", ["x"], "label", ml.svm(iterations=5), k=2)


def test_steps_reach_the_minimum():
    """Of mean hinge loss and squared weights, compared with many small steps."""
    draw = np.random.default_rng(3)
    z = np.hstack([draw.normal(size=(200, 3)), np.ones((200, 1))])
    y = np.where(z[:, 0] + draw.normal(size=200) > 0, 1.0, -1.0)

    def loss(w):
        slack = 1 - y * (z @ w)
        return np.maximum(slack, 0).mean() + 0.005 * (w[:3] ** 2).sum(), -z.T @ (y * (slack > 0)) / 200 + 0.01 * np.append(w[:3], 0)

    search = ml._minimised(np.zeros(4), 30, 1e-6)
    at = next(search)
    with pytest.raises(StopIteration) as end:
        while True:
            at = search.send(loss(at))
    w, least = np.zeros(4), np.inf
    for i in range(20000):
        value, grad = loss(w)
        least, w = min(least, value), w - grad / (1 + 0.01 * i)
    assert loss(end.value.value)[0] <= least * 1.005


def test_as_many_parts_as_classes_and_centres(spark, three):
    out = ml.cluster_membership(three, ["x", "y"], label="label")
    assert out.columns[-3:] == ["membership_0", "membership_1", "membership_2"]
    with pytest.raises(ValueError):
        ml.cluster_membership(three, ["x", "y"])
    model, _ = ml.kmeans(three.withColumn("v", F.array("x", "y")), "v", 3)
    lines = [r.line for r in ml.centre_lines(model, spark).collect()]
    assert [[float(x) for x in line.split(",")] for line in lines] == [pytest.approx(list(c)) for c in model.clusterCenters()]


def test_scoring_checks_the_header(three, tmp_path):
    path = str(tmp_path / "model")
    Pipeline(stages=[VectorAssembler(inputCols=["x", "y"], outputCol="v")]).fit(three).save(path)
    head = T.StructType([three.schema["x"], three.schema["y"], T.StructField("label", T.StringType())])
    assert ml.batch_score(path, three, head).count() == 90
    with pytest.raises(ValueError, match="class"):
        ml.batch_score(path, three, T.StructType([three.schema["x"], three.schema["y"]]))
    with pytest.raises(ValueError, match="x"):
        ml.batch_score(path, three.withColumn("x", F.lit("no")), head)


def test_extractors_by_name():
    images.register("corner", lambda image: [image[0, 0].astype(float)])
    try:
        with pytest.raises(ValueError):
            images.register("corner", lambda image: [])
        assert "corner" in images.EXTRACTORS
    finally:
        del images.EXTRACTORS["corner"]


def test_quotes_and_tasks(spark, tmp_path):
    path = tmp_path / "single.csv"
    path.write_text("a,b\n'x, y',1\nz,2\n")
    assert [tuple(r) for r in files.typed_csv(spark, str(path), quote="'").collect()] == [("x, y", 1.0), ("z", 2.0)]
    for i in range(3):
        (tmp_path / f"f{i}.bin").write_bytes(b"%d" % i)
    got = files.binary_files(spark, str(tmp_path), glob="*.bin", files_per_task=0)
    assert sorted(r.key for r in got.collect()) == ["f0", "f1", "f2"]


def test_archive_to_parquet(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar", "w") as archive:
        for name, data in (("d/one", b"1"), ("two", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    out = files.tar_to_parquet(spark, str(tmp_path / "a.tar"), str(tmp_path / "out"))
    assert sorted((r.name, bytes(r.content)) for r in out.collect()) == [("d/one", b"1"), ("two", b"")]
