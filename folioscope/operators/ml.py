"""Training, cross-validation, and classifiers that combine or look up distributions. Distributions are array<double> columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.scalars import argmax
from folioscope.shared import written

#: Parts that a class is sorted in when folds are dealt.
BUCKETS = 1024
#: What support vectors pay for the squares of their weights, and by how little (relatively) their loss still has to fall.
SVM_REG, SVM_TOL = 0.01, 1e-6
#: Rows times models that a worker holds at once.
BLOCK_CELLS = 1_000_000
#: fit(train, features, label) -> score(rows) -> rows with ``distribution`` and ``pred``
Fit = Callable[[DataFrame, Sequence[str], str], Callable[[DataFrame], DataFrame]]


def clean(df: DataFrame, label: str) -> DataFrame:
    """Rows that have a class."""
    return df.dropna(subset=[label])


def folds(df: DataFrame, key: str, label: str, k: int = 10, seed: int = 1) -> DataFrame:
    """Adds fold, 0..k-1: within a class rows are dealt in the order of a hash, so folds have equal shares of each class.

    A class is sorted in BUCKETS parts; what comes before a part is the sum of the counts of those before it."""
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(BUCKETS)))
    before = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(label, "__bucket").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(F.col(label).alias("__label"), F.col("__bucket").alias("__part"), "__before")
    place = F.row_number().over(Window.partitionBy(label, "__bucket").orderBy(F.xxhash64(F.lit(seed), key), key))
    out = dealt.withColumn("__place", place).join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__part")))
    return out.withColumn("fold", ((F.col("__before") + F.col("__place") - 1) % k).cast("int")).drop("__bucket", "__place", "__label", "__part", "__before")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: (2 + (1/K) / share of the class) / 3."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__total"), F.count("*").alias("__k"))
    w = n.crossJoin(total).select(label, ((2 + (1 / F.col("__k")) / (F.col("__n") / F.col("__total"))) / 3).alias("weight"))  # one row a class
    return df.join(w, label)


def _assembled(features: Sequence[str], scale: bool) -> list:
    steps = [VectorAssembler(inputCols=list(features), outputCol="__raw" if scale else "__features", handleInvalid="keep")]
    return [*steps, StandardScaler(inputCol="__raw", outputCol="__features", withMean=False)] if scale else steps


def _with_names(scored: DataFrame, labels: Sequence[str], distribution: Column) -> DataFrame:
    names = F.array(*[F.lit(x) for x in labels])
    out = scored.withColumn("distribution", distribution)
    out = out.withColumn("pred", names[argmax(F.col("distribution")).cast("int")])
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _one_against_rest(make: Callable[[], object], scale: bool) -> Fit:
    """A learner of Spark's for two classes; made when it is fitted, as that needs a session."""

    def fit(train: DataFrame, features: Sequence[str], label: str):
        index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc")
        learner = OneVsRest(classifier=make().setRawPredictionCol("__r"), featuresCol="__features", labelCol="__label", predictionCol="__pred", rawPredictionCol="__r")
        model = Pipeline(stages=[index, *_assembled(features, scale), learner]).fit(train)
        labels = model.stages[0].labels
        rest = PipelineModel(model.stages[1:])

        def score(rows: DataFrame) -> DataFrame:
            out = rest.transform(rows)
            return _with_names(out, labels, F.array(*[(F.col("__pred") == i).cast("double") for i in range(len(labels))]))

        score.labels = labels
        return score

    return fit


def svm(scale: bool = True, iterations: int = 30) -> Fit:
    """Linear support vectors, one class against the rest; the distribution is one-hot, as votes of such a classifier are.

    In a cross-validation the models of all folds and classes are trained side by side (``_svm_folds``), as each one by
    itself takes a job of Spark's an iteration. Its features are standardised with or without ``scale``."""
    fit = _one_against_rest(lambda: LinearSVC(maxIter=iterations, regParam=SVM_REG), scale)
    fit.folds = lambda dealt, key, features, label, k: _svm_folds(dealt, key, features, label, k, iterations)
    return fit


def _probable(make: Callable[[], object], scale: bool) -> Fit:
    """A learner of Spark's that gives probabilities."""

    def fit(train: DataFrame, features: Sequence[str], label: str):
        index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc")
        learner = make()
        own = learner.copy({learner.featuresCol: "__features", learner.labelCol: "__label", learner.predictionCol: "__pred", learner.probabilityCol: "__p", learner.rawPredictionCol: "__r"})
        model = Pipeline(stages=[index, *_assembled(features, scale), own]).fit(train)
        labels, rest = model.stages[0].labels, PipelineModel(model.stages[1:])

        def score(rows: DataFrame) -> DataFrame:
            return _with_names(rest.transform(rows), labels, vector_to_array("__p"))

        score.labels = labels
        return score

    return fit


def logistic(scale: bool = True, iterations: int = 50, weight: str | None = None) -> Fit:
    """Multinomial logistic regression, for distributions that are probabilities."""
    return _probable(lambda: LogisticRegression(maxIter=iterations, regParam=0.01, **({"weightCol": weight} if weight else {})), scale)


def tree(depth: int = 10, weight: str | None = None) -> Fit:
    return _probable(lambda: DecisionTreeClassifier(maxDepth=depth, seed=1, **({"weightCol": weight} if weight else {})), False)


def forest(trees: int = 50, depth: int = 8, seed: int = 1, weight: str | None = None) -> Fit:
    return _probable(lambda: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **({"weightCol": weight} if weight else {})), False)


def bayes(weight: str | None = None) -> Fit:
    """Naive Bayes with a normal distribution of each feature in each class."""
    return _probable(lambda: NaiveBayes(modelType="gaussian", **({"weightCol": weight} if weight else {})), False)


def boosting(rounds: int = 20, depth: int = 3, seed: int = 1) -> Fit:
    """Boosted trees, one class against the rest; the distribution is one-hot."""
    return _one_against_rest(lambda: GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed), False)


def pairwise_svm(scale: bool = True, iterations: int = 30, degree: int = 1) -> Fit:
    """Support vectors for each pair of classes, which vote; the distribution is each class's share of the votes, ties go to the first class.

    ``degree`` above 1 adds all products of so many features at most, which a polynomial kernel would work on. The
    prepared rows are cached while the K(K-1)/2 models are trained.
    """

    def fit(train: DataFrame, features: Sequence[str], label: str):
        index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc")
        more = [PolynomialExpansion(degree=degree, inputCol="__features", outputCol="__products")] if degree > 1 else []
        ready = Pipeline(stages=[index, *_assembled(features, scale), *more]).fit(train)
        vector = "__products" if more else "__features"
        labels, rest = ready.stages[0].labels, PipelineModel(ready.stages[1:])
        prepared = ready.transform(train).select("__label", vector).persist()
        models = []
        for a in range(len(labels)):
            for b in range(a + 1, len(labels)):
                both = prepared.filter(F.col("__label").isin(a, b)).withColumn("__side", (F.col("__label") == a).cast("double"))
                learner = LinearSVC(maxIter=iterations, regParam=0.01, featuresCol=vector, labelCol="__side", predictionCol=f"__vote_{a}_{b}", rawPredictionCol=f"__margin_{a}_{b}")
                models.append((a, b, learner.fit(both)))
        prepared.unpersist()

        def score(rows: DataFrame) -> DataFrame:
            out = rest.transform(rows)
            votes = [F.lit(0.0)] * len(labels)
            for a, b, model in models:
                out = model.transform(out)
                won = F.col(f"__vote_{a}_{b}")
                votes[a], votes[b] = votes[a] + won, votes[b] + (1 - won)
            return _with_names(out, labels, F.array(*[v / len(models) for v in votes]) if models else F.array(F.lit(1.0)))

        score.labels = labels
        return score

    return fit


def _minimised(x: np.ndarray, iterations: int, tol: float, memory: int = 10):
    """A generator that names points, is sent (value, gradient) of each, and returns the best: limited-memory quasi-Newton steps.

    A step is halved between bounds until it meets the weak Wolfe conditions, which kinks of the hinge loss allow."""
    value, grad = yield x
    values, steps = [value], []
    for i in range(iterations):
        way, used = -grad, []
        for s, y, rho in reversed(steps):
            used.append(rho * s.dot(way))
            way = way - used[-1] * y
        if steps:
            s, y, _ = steps[-1]
            way = way * (s.dot(y) / y.dot(y))
        for (s, y, rho), a in zip(steps, reversed(used)):
            way = way + s * (a - rho * y.dot(way))
        slope = way.dot(grad)
        if slope >= 0:
            return x
        step, low, high = 0.5 / np.linalg.norm(grad) if i == 0 else 1.0, 0.0, np.inf
        for _ in range(20):
            to = x + step * way
            got, to_grad = yield to
            if got > value + 1e-4 * step * slope:
                high = step
            elif to_grad.dot(way) < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * step
        if got >= value:
            return x
        s, y = to - x, to_grad - grad
        if s.dot(y) > 0:
            steps = [*steps, (s, y, 1 / s.dot(y))][-memory:]
        x, value, grad = to, got, to_grad
        values.append(value)
        if np.linalg.norm(grad) <= max(tol * abs(value), 1e-8) or np.mean(values[-11:-1]) - value <= tol * abs(value):
            return x
    return x


def _by_task(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What work(vectors, folds, classes) adds up to in each task, a matrix."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                vectors = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                part = work(vectors, b.column("fold").to_numpy(zero_copy_only=False), b.column("y").to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": [total.tobytes()], "n": [len(total)]}, schema=pa.schema([("m", pa.binary()), ("n", pa.int32())]))

    found = rows.select("x", "fold", "y").mapInArrow(run, "m binary, n int").collect()
    return [np.frombuffer(r.m).reshape(r.n, -1) for r in found]


def _svm_folds(dealt: DataFrame, key: str, features: Sequence[str], label: str, k: int, iterations: int) -> DataFrame:
    """(key, fold, gold, pred) of dealt rows, each scored by the models that were trained without its fold.

    A model is LinearSVC's: the mean hinge loss, plus SVM_REG / 2 times the squared weights of features that are centred
    and divided by their deviation in the model's own rows. A job evaluates one point of each model over all rows, by
    matrix products, and brings back sums of the size of the models (folds x classes x features) from each task.
    """
    ready = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="keep").transform(dealt)
    ready = written(ready.select(key, "fold", F.col(label).alias("gold"), vector_to_array("__x").alias("__x"), F.col(label).cast("string").alias("__name")), "dealt")
    counts = ready.groupBy("fold", "__name").agg(F.count("*").alias("n")).collect()
    names = sorted({r["__name"] for r in counts})
    if not names:
        return ready.select(key, "fold", "gold", F.lit(None).cast("string").alias("pred"))
    name = F.array(*[F.lit(x) for x in names])
    rows = ready.select(F.col("__x").alias("x"), "fold", (F.array_position(name, F.col("__name")) - 1).cast("int").alias("y"))
    n = np.zeros((k, len(names)))
    for r in counts:
        n[r["fold"], names.index(r["__name"])] = r["n"]
    without = n.sum(0) - n  # of each fold, the rows of each class that its models see
    if any(n[i].any() and not without[i].any() for i in range(k)):
        raise ValueError("a fold leaves no rows to train on")
    models = [(i, c) for i in range(k) if n[i].any() for c in range(len(names)) if without[i, c]]
    own, classes = np.array(models).T
    size = without.sum(1)[own]

    def moments(about, power):
        def work(x, fold, y):
            if not np.isfinite(x).all():
                raise ValueError("a feature is null or not finite")
            return np.stack([((x[fold == i] - about[i]) ** power).sum(0) for i in range(k)])

        return sum(_by_task(rows, work))

    sums = moments(np.zeros((k, 1)), 1)
    width = sums.shape[1]
    fold_n = n.sum(1)
    middle = sums.sum(0) / fold_n.sum()
    mean_by_fold = sums / np.maximum(fold_n, 1)[:, None]
    squares = moments(mean_by_fold, 2)
    mean, deviation = np.zeros((k, width)), np.zeros((k, width))
    for i in range(k):
        seen = np.arange(k) != i
        m = fold_n[seen].sum()
        if m:
            mean[i] = sums[seen].sum(0) / m
            spread = squares[seen].sum(0) + (fold_n[seen][:, None] * (mean_by_fold[seen] - mean[i]) ** 2).sum(0)
            deviation[i] = np.sqrt(spread / max(m - 1, 1))
    inverse = np.divide(1, deviation, out=np.zeros_like(deviation), where=deviation > 0)[own].T
    centre = (mean - middle)[own].T

    def evaluate(at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and gradients of some models; a column a model, weights, then the intercept."""
        raw = at[:-1] * inverse[:, which]
        shift = at[-1] - (centre[:, which] * raw).sum(0)
        mine, side, block = own[which], classes[which], max(1, BLOCK_CELLS // len(which))

        def work(x, fold, y):
            total = np.zeros((width + 2, len(mine)))
            for a in range(0, len(x), block):
                b = slice(a, a + block)
                z = x[b] - middle
                sign = np.where(y[b, None] == side, 1.0, -1.0)
                slack = 1 - sign * (z @ raw + shift)
                sign[(slack <= 0) | (fold[b, None] == mine)] = 0
                total[:width] -= z.T @ sign
                total[width] -= sign.sum(0)
                total[width + 1] += (slack * abs(sign)).sum(0)
            return total

        got = sum(_by_task(rows, work)) / size[which]
        weights = (got[:width] - centre[:, which] * got[width]) * inverse[:, which] + SVM_REG * at[:-1]
        return got[width + 1] + SVM_REG / 2 * (at[:-1] ** 2).sum(0), np.vstack([weights, got[width]])

    found = np.zeros((width + 1, len(models)))
    searches = [_minimised(found[:, j].copy(), iterations, SVM_TOL) for j in range(len(models))]
    points = {j: next(search) for j, search in enumerate(searches)}
    while points:
        which = np.array(sorted(points))
        values, grads = evaluate(np.stack([points[j] for j in which], axis=1), which)
        for at, j in enumerate(which):
            try:
                points[j] = searches[j].send((values[at], grads[:, at]))
            except StopIteration as end:
                found[:, j] = end.value
                del points[j]

    raw = found[:-1] * inverse
    shift = found[-1] - (centre * raw).sum(0)

    @F.pandas_udf("int")
    def best(x: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype="int32")
        for i in set(fold):
            at, mine = (fold == i).to_numpy(), own == i
            out[at] = classes[mine][((np.stack(list(x[at])) - middle) @ raw[:, mine] + shift[mine]).argmax(1)]
        return pd.Series(out)

    return ready.select(key, "fold", "gold", F.get(name, best("__x", "fold")).alias("pred"))


def cross_validate(df: DataFrame, key: str, features: Sequence[str], label: str, fit: Fit, k: int = 10, seed: int = 1) -> DataFrame:
    """(key, fold, gold, pred): every row scored by a model that hasn't seen it. A fit with an attribute ``folds`` trains for all folds at once."""
    dealt = folds(clean(df, label), key, label, k, seed)
    if hasattr(fit, "folds"):
        return fit.folds(dealt, key, features, label, k)
    out = None
    for i in range(k):
        score = fit(dealt.filter(F.col("fold") != i), features, label)
        part = score(dealt.filter(F.col("fold") == i)).select(key, "fold", F.col(label).alias("gold"), "pred")
        out = part if out is None else out.unionByName(part)
    return out


def evaluate_split(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, fit: Fit) -> DataFrame:
    return fit(clean(train, label), features, label)(test)


def prefix_features(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def average(df: DataFrame, *distributions: str, name: str = "distribution") -> DataFrame:
    """The mean of several distributions; one that is null or all zeros takes no part in it."""
    given = F.filter(F.array(*[F.col(d) for d in distributions]), lambda d: d.isNotNull() & F.exists(d, lambda x: x > 0))
    total = F.aggregate(given, F.transform(F.col(distributions[0]), lambda x: F.lit(0.0)), lambda a, d: F.zip_with(a, d, lambda x, y: x + y))
    return df.withColumn(name, F.when(F.size(given) > 0, F.transform(total, lambda x: x / F.size(given))).otherwise(F.col(distributions[0])))


def sure_gate(distribution: Column, labels: Sequence[str], sure: Sequence[str]) -> Column:
    """One-hot where the best class is one of the sure ones, else even."""
    k = len(labels)
    best = argmax(distribution)
    is_sure = best.isin(*[i for i, x in enumerate(labels) if x in sure])
    return F.when(is_sure, F.array(*[(best == i).cast("double") for i in range(k)])).otherwise(F.array(*[F.lit(1.0 / k)] * k))


def precomputed(df: DataFrame, key: str, predictions: DataFrame, labels: Sequence[str], smooth: float | None = None) -> DataFrame:
    """Adds pred and distribution from a table (key, label). Unknown keys: null, and all zeros. smooth s in [0, 1) gives the label 1/(1 + s(K-1)) and the others equal shares of the rest."""
    k, s = len(labels), smooth or 0.0
    if not 0 <= s < 1:
        raise ValueError("smooth must be in [0, 1)")
    top = 1 / (1 + s * (k - 1))
    other = (1 - top) / (k - 1) if k > 1 else 0.0
    out = df.join(predictions.select(key, F.when(F.col("label").isNull() | F.col("label").isin(*labels), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("not a class: "), F.col("label"))).cast("string")).alias("pred")), key, "left")
    cells = F.array(*[F.when(F.col("pred").isNull(), 0.0).when(F.col("pred") == x, top).otherwise(other) for x in labels])
    return out.withColumn("distribution", cells)


def map_labels(column: Column, mapping: Mapping[str, str]) -> Column:
    """Nominal values by a map; a value that isn't in it becomes null."""
    return F.try_element_at(F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]), column)


class Hierarchy:
    """A tree of labels: children by parent; leaves are the classes."""

    def __init__(self, children: Mapping[str, Sequence[str]], root: str):
        self.children, self.root = {k: list(v) for k, v in children.items()}, root

    @classmethod
    def of_groups(cls, pairs: Sequence[tuple[str | None, str]], root: str = "ROOT") -> Hierarchy:
        """root, the groups, and their classes, from (class, group) in order; what has no class is left out, and so are groups without any."""
        groups = list(dict.fromkeys(group for name, group in pairs if name is not None))
        return cls({root: groups} | {g: list(dict.fromkeys(name for name, group in pairs if group == g and name is not None)) for g in groups}, root)

    def leaves(self, node: str | None = None) -> list[str]:
        node = self.root if node is None else node
        below = self.children.get(node)
        return [x for c in below for x in self.leaves(c)] if below else [node]

    def inner(self) -> list[str]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop(0)
            if node in self.children:
                out.append(node)
                todo += self.children[node]
        return out

    def branch(self, node: str) -> dict[str, str]:
        """Each class below a node -> the node's child that leads to it."""
        return {leaf: c for c in self.children[node] for leaf in self.leaves(c)}


def hierarchical(tree: Hierarchy, base: Fit, weighted: bool = False) -> Fit:
    """A model at every inner node, at any depth. Scores follow the best child from the root, or multiply along every path."""

    def fit(train: DataFrame, features: Sequence[str], label: str):
        models = {}
        for node in tree.inner():
            own = train.withColumn("__branch", map_labels(F.col(label), tree.branch(node))).filter("__branch is not null").withColumn("branch", F.col("__branch")).drop("__branch")
            models[node] = base(own, features, "branch")
        labels = sorted(tree.leaves())

        def score(rows: DataFrame) -> DataFrame:
            out = rows
            for n, (node, model) in enumerate(models.items()):
                got = model(out)
                out = got.withColumn(f"node_{n}", F.map_from_arrays(F.array(*[F.lit(x) for x in model.labels]), "distribution")).drop("distribution", "pred")
            number = {node: n for n, node in enumerate(models)}
            share = lambda node, child: F.coalesce(F.try_element_at(F.col(f"node_{number[node]}"), F.lit(child)), F.lit(0.0))

            def paths(node: str, so_far: Column, taken: Column) -> dict[str, Column]:
                found: dict[str, Column] = {}
                best = F.array_max(F.transform(F.map_entries(F.col(f"node_{number[node]}")), lambda e: F.struct(e["value"], e["key"])))["key"]
                for c in tree.children[node]:
                    p, here = so_far * share(node, c), taken & (best == c)
                    found |= paths(c, p, here) if c in tree.children else {c: p if weighted else F.when(here, 1.0).otherwise(0.0)}
                return found

            leaf = paths(tree.root, F.lit(1.0), F.lit(True))
            out = out.withColumn("distribution", F.array(*[leaf[x] for x in labels]))
            out = out.withColumn("pred", F.array(*[F.lit(x) for x in labels])[argmax(F.col("distribution")).cast("int")])
            return out.drop(*[f"node_{n}" for n in number.values()])

        score.labels = labels
        return score

    return fit


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 1):
    """(model, df with cluster_id); vectors are arrays."""
    ready = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=k, seed=seed, predictionCol="cluster_id").fit(ready)
    return model, model.transform(ready).drop("features")


def centres(model, spark) -> DataFrame:
    """(cluster_id, centre): as many rows as clusters."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centre array<double>")


def centre_lines(model, spark) -> DataFrame:
    """A centre's numbers, joined by commas, one line a centre in the order of clusters."""
    return centres(model, spark).orderBy("cluster_id").select(F.array_join(F.transform("centre", lambda x: x.cast("string")), ",").alias("line"))


def cluster_membership(df: DataFrame, features: Sequence[str], k: int | None = None, seed: int = 1, label: str | None = None) -> DataFrame:
    """Adds membership_<i>, the probabilities of a Gaussian mixture over the features; without k, of as many parts as ``label`` has classes."""
    if k is None:
        if label is None:
            raise ValueError("either k or a label")
        k = max(2, df.agg(F.count_distinct(label)).first()[0])
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    out = GaussianMixture(k=k, seed=seed, probabilityCol="__p", predictionCol="__c").fit(ready).transform(ready)
    p = vector_to_array("__p")
    return out.select(*df.columns, *[p[i].alias(f"membership_{i}") for i in range(k)])


def batch_score(model_path: str, rows: DataFrame, header: T.StructType | None = None) -> DataFrame:
    """A saved pipeline applied to rows. With a header, its last column must be the class, of type string, and rows must have all others with their types."""
    if header is not None:
        if not header.fields or not isinstance(header.fields[-1].dataType, T.StringType):
            raise ValueError("the last column of the header must be the class, as a string")
        there = {f.name: f.dataType for f in rows.schema.fields}
        wrong = [f.name for f in header.fields[:-1] if there.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"rows don't fit the header: {', '.join(wrong)}")
    return PipelineModel.load(model_path).transform(rows)
