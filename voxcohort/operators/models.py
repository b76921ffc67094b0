"""Cross-validated classifiers on feature tables, with every fit inside its training fold.

The classifier is a Spark ML one, made by a factory; what is kept from the study this follows is the shape of
the work: folds shared by all arms, fold-local preparation, class weights, out-of-fold predictions."""

from __future__ import annotations

import itertools
import math
import random
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.operators import evaluate, foldstats, prep
from voxcohort.plans.storage import shared_dir, stored

ARMS = ("none", "correlation", "full", "attribution")
#: Parameter sets that the inner search draws from.
#: "top" is the number of features that the arm full keeps.
TOPS = (20, 30, 50, 75)
GRID: dict[str, Sequence] = {"numTrees": (20, 50, 100), "maxDepth": (3, 4, 5), "featureSubsetStrategy": ("sqrt", "onethird"), "minInstancesPerNode": (1, 3)}

BOOSTED_GRID: dict[str, Sequence] = {"maxIter": (10, 20), "maxDepth": (2, 3, 4), "stepSize": (0.05, 0.1), "subsamplingRate": (0.8, 1.0)}

Factory = Callable[..., object]


def forest(**params) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=42, **params)


def boosted(**params) -> OneVsRest:
    """One boosted binary classifier per class."""
    return OneVsRest(classifier=GBTClassifier(seed=42, **params), featuresCol="features", labelCol="label", weightCol="weight")


def probe(factory: Factory) -> dict:
    """Parameters of the small model that selections look at."""
    return {"maxIter": 10, "maxDepth": 3} if factory is boosted else {"numTrees": 20, "maxDepth": 4}


def importances(model) -> np.ndarray:
    """Impurity importances; of one model per class their mean."""
    parts = model.models if isinstance(model, OneVsRestModel) else [model]
    return np.mean([m.featureImportances.toArray() for m in parts], axis=0)


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


@dataclass
class Arm:
    """Fitted steps of an arm and the features they leave."""

    steps: list[prep.Columnwise]
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.transform(df)
        return df


def build_arm(train: DataFrame, arm: str, features: Sequence[str], class_col: str, top: int = 30, factory: Factory = forest) -> Arm:
    """Median imputation, scaling and a variance filter; then a correlation filter, and a selection by importance (full) or attribution."""
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm!r}")
    out = Arm([prep.median_imputer(train, features)], list(features))
    now = out.transform(train)
    out.steps.append(prep.standardizer(now, out.features))
    now = out.steps[-1].transform(now)
    out.steps.append(prep.variance_filter(now, out.features))
    out.features = list(out.steps[-1].keep or [])
    now = out.steps[-1].transform(now)
    if arm in ("correlation", "full"):
        out.steps.append(prep.correlation_filter(now, out.features, class_col, rule="fscore"))
        out.features = list(out.steps[-1].keep or [])
        now = out.steps[-1].transform(now)
    if arm in ("full", "attribution") and len(out.features) > top:
        chosen = (importance_selector if arm == "full" else attribution_selector)(now, out.features, top, factory)
        out.steps.append(prep.Columnwise(keep=chosen, features=out.features))
        out.features = chosen
    return out


def importance_ranking(train: DataFrame, features: Sequence[str], factory: Factory = forest) -> list[str]:
    """The features by their importance in a probe fitted on train (with label and weight), largest first."""
    score = importances(factory(**probe(factory)).fit(assembled(train, features)))
    return [features[i] for i in np.argsort(-score, kind="stable")]


def attribution_ranking(train: DataFrame, features: Sequence[str], factory: Factory = forest) -> list[str]:
    """The features by their mean absolute attribution in a probe fitted on train, largest first."""
    rows = assembled(train, features)
    model = factory(**probe(factory)).fit(rows)
    score = {r["feature"]: r["importance"] for r in tree_attributions(model, rows, features).collect()}
    return sorted(features, key=lambda f: (-score.get(f, 0.0), f))


def importance_selector(train: DataFrame, features: Sequence[str], top: int, factory: Factory = forest) -> list[str]:
    """The features of largest importance in a probe fitted on train, in their own order."""
    best = set(importance_ranking(train, features, factory)[:top])
    return [f for f in features if f in best]


def attribution_selector(train: DataFrame, features: Sequence[str], top: int, factory: Factory = forest) -> list[str]:
    """The features of largest mean absolute attribution in a probe fitted on train, in their own order."""
    best = set(attribution_ranking(train, features, factory)[:top])
    return [f for f in features if f in best]


def labelled(df: DataFrame, class_col: str) -> DataFrame:
    """df with label (sorted classes) as a double."""
    from voxcohort.operators.cohort import encode_labels

    return encode_labels(df, class_col, "label").withColumn("label", F.col("label").cast("double"))


def predicted(model, rows: DataFrame, classes: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep, pred_label (first class of the largest probability) and prob_<class>."""
    out = model.transform(rows)
    if "probability" in out.columns:
        p = vector_to_array("probability")
    else:  # one against the rest: margins as probabilities that add up to 1
        raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))
        p = F.transform(raw, lambda v: v / F.aggregate(raw, F.lit(0.0), lambda a, b: a + b))
    out = out.withColumn("_p", p)
    names = F.array(*map(F.lit, classes))
    best = F.element_at(names, F.array_position("_p", F.array_max("_p")).cast("int"))
    return out.select(*keep, best.alias("pred_label"), *(F.col("_p")[i].alias(f"prob_{c}") for i, c in enumerate(classes)))


@dataclass
class CvResult:
    """Out-of-fold predictions, and per fold the metrics, features and parameters, all as DataFrames."""

    predictions: DataFrame
    features: DataFrame
    params: list[dict] = field(default_factory=list)

    def fold_metrics(self, classes: Sequence[str]) -> DataFrame:
        """arm, fold, n_test, accuracy, f1_macro, f1_weighted, auc_ovr, n_features, best_params (as text, null without a search)."""
        keys = ["arm", "fold"]
        m = evaluate.classification_metrics(self.predictions, keys).withColumnRenamed("n", "n_test")
        m = m.join(evaluate.auc_ovr(self.predictions, keys, classes), keys, "left").join(self.features.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_features")), keys, "left")
        rows = [(p["arm"], p["fold"], ", ".join(f"{k}={v}" for k, v in sorted(p.items()) if k not in keys)) for p in self.params]
        return m.join(F.broadcast(_table(rows, "arm string, fold int, best_params string", self.predictions)), keys, "left")  # a row per arm and fold


def _table(rows: list[tuple], schema: str, like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def drawn(grid: Mapping[str, Sequence], n_iter: int, seed: int) -> list[dict]:
    """n_iter parameter sets of a grid without repetition, or all if there are fewer."""
    sets = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    return random.Random(seed).sample(sets, min(n_iter, len(sets)))


def macro_f1(cells: Sequence[tuple]) -> float:
    """From (true, predicted, n): the mean F1 over the classes that occur as either."""
    hit, true, guess = {}, {}, {}
    for t, p, n in cells:
        true[t], guess[p] = true.get(t, 0) + n, guess.get(p, 0) + n
        hit[t] = hit.get(t, 0) + (n if t == p else 0)
    return float(np.mean([2 * hit.get(c, 0) / (true.get(c, 0) + guess.get(c, 0)) for c in {*true, *guess}]))


class Folds:
    """Arms fitted on the training sets of a nested cross-validation, from statistics that add up over folds.

    base has label, weight per outer fold by classes, fold and inner_fold. Every preparation, the choice of features
    included, is fitted on the very rows that the model is fitted on: for the inner search, on those outside the inner fold.
    """

    def __init__(self, base: DataFrame, features: Sequence[str], classes: Sequence[str], outer: int, inner: int, factory: Factory, top: int) -> None:
        self.base, self.classes, self.factory, self.top = base, list(classes), factory, top
        self.sums = foldstats.gather(base, features, "label", len(classes), outer, inner)

    def rows(self, outer: int, inner: int | None = None, left_out: bool = False) -> DataFrame:
        """A training set with its weights, or what was left out of it: the outer fold, or an inner one of the outer training set."""
        inside = F.col("fold") != outer
        if inner is not None:
            inside = inside & ((F.col("inner_fold") == inner) if left_out else (F.col("inner_fold") != inner))
        elif left_out:
            inside = ~inside
        n = np.diag(self.sums.training(outer))[-len(self.classes) :]
        weight = F.element_at(F.array(*(F.lit(float(n.sum() / (np.count_nonzero(n) * max(x, 1.0)))) for x in n)), F.col("label").cast("int") + 1)
        return self.base.filter(inside).withColumn("weight", weight)

    def prepared(self, arm: str, outer: int, inner: int | None = None) -> Arm:
        steps, kept = foldstats.prepared(self.sums, outer, inner, 0.90 if arm in ("correlation", "full") else None)
        return Arm(steps, kept)

    def ranking(self, arm: str, fitted: Arm, train: DataFrame) -> list[str] | None:
        """All features of the arm by a probe fitted on its training set, best first; None for arms without a choice."""
        if arm not in ("full", "attribution") or not fitted.features:
            return None
        choose = importance_ranking if arm == "full" else attribution_ranking
        return choose(fitted.transform(train), fitted.features, self.factory)

    def chosen(self, fitted: Arm, ranking: list[str] | None, params: Mapping) -> tuple[list[str], dict]:
        """The features and the model's own parameters under a parameter set."""
        params = dict(params)
        top = params.pop("top", self.top)
        if ranking is None or len(fitted.features) <= top:
            return fitted.features, params
        best = set(ranking[:top])
        return [f for f in fitted.features if f in best], params

    def search(self, arm: str, outer: int, sets: Sequence[dict], inner: int, parallel: int = 4) -> dict:
        """The set of the largest mean macro F1 over the inner folds; earlier sets win ties. Only class counts reach the driver."""
        if len(sets) == 1:
            return sets[0]
        scores = np.zeros((len(sets), inner))
        for j in range(inner):
            train, left = self.rows(outer, j), self.rows(outer, j, left_out=True)
            fitted = self.prepared(arm, outer, j)
            ranking = self.ranking(arm, fitted, train)
            ready, test = fitted.transform(train).persist(), fitted.transform(left).persist()

            def tried(i: int, j: int = j, fitted: Arm = fitted, ranking: list[str] | None = ranking, ready: DataFrame = ready, test: DataFrame = test) -> None:
                features, params = self.chosen(fitted, ranking, sets[i])
                model = self.factory(**params).fit(assembled(ready, features))
                cells = predicted(model, assembled(test, features), self.classes, ["true_label"]).groupBy("true_label", "pred_label").count().collect()
                scores[i, j] = macro_f1(cells)

            with ThreadPoolExecutor(parallel) as pool:
                list(pool.map(tried, range(len(sets))))
            ready.unpersist()
            test.unpersist()
        return sets[int(np.argmax(scores.mean(axis=1)))]


def nested_cv(df: DataFrame, arms: Sequence[str], features: Sequence[str], id_col: str, class_col: str, outer: int = 5, inner: int = 3, n_iter: int = 25, grid: Mapping[str, Sequence] = GRID, factory: Factory = forest, seed: int = 42, top: int = 30, tops: Sequence[int] = TOPS, parallel: int = 5) -> CvResult:
    """Each arm over the same outer folds: inner search over preparation and model as a whole, refit, predictions of the fold left out.

    The arm full searches over the number of features (tops) too. Every arm draws n_iter parameter sets.
    """
    if wrong := set(arms) - set(ARMS):
        raise ValueError(f"unknown arms {sorted(wrong)}")
    base = evaluate.stratified_folds(labelled(df.select(id_col, class_col, *features), class_col), id_col, class_col, outer, seed)
    base = evaluate.stratified_folds(base, id_col, class_col, inner, seed + 1, ["fold"], "inner_fold").withColumn("true_label", F.col(class_col))
    base = stored(base, "cv-folds")
    classes = sorted(r[0] for r in base.select(class_col).distinct().collect())
    folds = Folds(base, features, classes, outer, inner, factory, top)
    def one(job: tuple[str, int]) -> tuple[DataFrame, list[tuple], dict]:
        arm, k = job
        sets = drawn({**grid, "top": tuple(tops)} if arm == "full" else grid, n_iter, seed)
        best = folds.search(arm, k, sets, inner)
        fitted, train = folds.prepared(arm, k), folds.rows(k)
        names, own = folds.chosen(fitted, folds.ranking(arm, fitted, train), best)
        model = factory(**own).fit(assembled(fitted.transform(train), names))
        test = assembled(fitted.transform(folds.rows(k, left_out=True)), names)
        part = predicted(model, test, classes, [id_col, class_col, "fold"]).withColumn("arm", F.lit(arm))
        return part, [(arm, k, f) for f in names], {"arm": arm, "fold": k, **best}

    # A fit's jobs are small beside what the cluster can do at once, so folds are searched side by side.
    with ThreadPoolExecutor(parallel) as pool:
        done = list(pool.map(one, itertools.product(arms, range(outer))))
    parts, kept, params = [d[0] for d in done], [x for d in done for x in d[1]], [d[2] for d in done]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumnRenamed(class_col, "true_label").withColumn("is_error", (F.col("true_label") != F.col("pred_label")).cast("int"))
    return CvResult(stored(out, "cv-predictions"), _table(kept, "arm string, fold int, feature string", df), params)


def plain_fold(train: DataFrame, group: Sequence[str], class_col: str, rule: str = "later") -> Arm:
    """Medians, features of any variance, correlation filter; no features where none varies."""
    fitted = Arm([prep.median_imputer(train, group)], list(group))
    fitted.steps.append(prep.variance_filter(fitted.transform(train), group, 1e-10, strict=True))
    fitted.features = list(fitted.steps[-1].keep or [])
    if fitted.features:
        fitted.steps.append(prep.correlation_filter(fitted.transform(train), fitted.features, class_col, rule=rule))
        fitted.features = list(fitted.steps[-1].keep or [])
    return fitted


def scaled_fold(train: DataFrame, group: Sequence[str], class_col: str, top: int = 30, factory: Factory = forest) -> Arm:
    """Medians, scaling, variance filter, correlation filter by F, the top features by attribution."""
    fitted = Arm([prep.median_imputer(train, group)], list(group))
    fitted.steps.append(prep.standardizer(fitted.transform(train), group))
    fitted.steps.append(prep.variance_filter(fitted.transform(train), group, 0.01, strict=True))
    fitted.features = list(fitted.steps[-1].keep or [])
    if fitted.features:
        fitted.steps.append(prep.correlation_filter(fitted.transform(train), fitted.features, class_col, rule="fscore_break"))
        fitted.features = list(fitted.steps[-1].keep or [])
        chosen = attribution_selector(fitted.transform(train), fitted.features, top, factory)
        fitted.steps.append(prep.Columnwise(keep=chosen, features=fitted.features))
        fitted.features = chosen
    return fitted


def fixed_cv(df: DataFrame, groups: Mapping[str, Sequence[str]], id_col: str, class_col: str, k: int = 5, fold: Callable[[DataFrame, Sequence[str], str], Arm] = plain_fold, factory: Factory = forest, seed: int = 42, **params) -> CvResult:
    """Cross-validation with one parameter set for each named group of features; arm is the group's name.

    A group without features, or of which a fold leaves none, has no predictions and no features.
    """
    every = sorted({f for g in groups.values() for f in g})
    base = stored(evaluate.stratified_folds(labelled(df.select(id_col, class_col, *every), class_col), id_col, class_col, k, seed), "cv-folds")
    classes = sorted(r[0] for r in base.select(class_col).distinct().collect())
    out, kept = None, []
    for name, group in groups.items():
        arms = []
        for i in range(k if group else 0):
            train = evaluate.balanced_weights(base.filter(F.col("fold") != i), class_col)
            arms.append((train, fold(train, group, class_col)))
        if not arms or not all(fitted.features for _, fitted in arms):
            continue
        for i, (train, fitted) in enumerate(arms):
            model = factory(**params).fit(assembled(fitted.transform(train), fitted.features))
            test = assembled(fitted.transform(base.filter(F.col("fold") == i)), fitted.features)
            part = predicted(model, test, classes, [id_col, class_col, "fold"]).withColumn("arm", F.lit(name))
            out = part if out is None else out.unionByName(part)
            kept += [(name, i, f) for f in fitted.features]
    if out is None:
        out = base.limit(0).select(id_col, class_col, "fold", F.col(class_col).alias("pred_label"), *(F.lit(0.0).alias(f"prob_{c}") for c in classes), F.lit("").alias("arm"))
    return CvResult(stored(out.withColumnRenamed(class_col, "true_label"), "cv-predictions"), _table(kept, "arm string, fold int, feature string", df))


def _of_all(groups: Mapping[str, Sequence[str]], found: DataFrame) -> DataFrame:
    """found with a row for each group, of nulls for those without predictions."""
    return _table([(g,) for g in groups], "arm string", found).join(found, "arm", "left")


def ablation(df: DataFrame, groups: Mapping[str, Sequence[str]], id_col: str, class_col: str, classes: Sequence[str], **how) -> DataFrame:
    """arm (group of features), and mean and deviation over folds of accuracy, f1_macro and auc_ovr."""
    result = fixed_cv(df, groups, id_col, class_col, **how)
    return _of_all(groups, evaluate.arm_summary(result.fold_metrics(classes), ["accuracy", "f1_macro", "auc_ovr"]))


def model_set_comparison(df: DataFrame, groups: Mapping[str, Sequence[str]], id_col: str, class_col: str, classes: Sequence[str], **how) -> DataFrame:
    """arm (model set) and the metrics of its out-of-fold predictions as a whole."""
    p = fixed_cv(df, groups, id_col, class_col, **how).predictions
    return _of_all(groups, evaluate.classification_metrics(p, ["arm"]).join(evaluate.auc_ovr(p, ["arm"], classes), "arm", "left"))


def sensitivity(df: DataFrame, features: Sequence[str], id_col: str, class_col: str, classes: Sequence[str], top: int = 30, **how) -> DataFrame:
    """One row: AUC before and after normalization to the reference, their difference and its verdict.

    Each fold is scaled, filtered by variance and by correlation and F, and reduced to the top features by attribution.
    """
    from voxcohort.functions.columns import bucket_label
    from voxcohort.operators.features import normalize_to_reference

    after = normalize_to_reference(df)
    left = [f for f in features if f in after.columns]
    out = None
    for name, table, names in (("original", df, features), ("normalized", after, left)):
        p = fixed_cv(table, {name: names}, id_col, class_col, fold=partial(scaled_fold, top=top, factory=how.get("factory", forest)), **how).predictions
        row = evaluate.auc_ovr(p, ["arm"], classes).select(F.col("auc_ovr").alias(f"auc_{name}"))
        out = row if out is None else out.join(F.broadcast(row), F.lit(True))  # one row each
    change = F.abs(F.col("auc_normalized") - F.col("auc_original"))
    return out.withColumn("delta_auc", F.col("auc_normalized") - F.col("auc_original")).withColumn("verdict", bucket_label(change, (0.02, 0.06), ("robust", "moderate", "sensitive")))


def refit(df: DataFrame, arm: str, features: Sequence[str], class_col: str, params: Mapping, path: str | None = None, factory: Factory = forest):
    """The arm fitted on all rows, and its model, saved if a path is given."""
    rows = evaluate.balanced_weights(labelled(df, class_col), class_col)
    fitted = build_arm(rows, arm, features, class_col, factory=factory)
    model = factory(**params).fit(assembled(fitted.transform(rows), fitted.features))
    if path:
        model.write().overwrite().save(path)
    return fitted, model


# --- attributions


@dataclass
class Leaf:
    """A leaf's value per class, and for each feature on its path the interval that leads there and its share of the cover."""

    value: np.ndarray
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def leaves(nodes: list[dict], value: Callable[[dict], np.ndarray] | None = None) -> list[Leaf]:
    """Leaves of one tree from its saved nodes (id, left, right, stats, prediction, feature, threshold).

    stats are counts of classes, and leaves hold their shares; with value they are a regression's (count first).
    """
    by = {n["id"]: n for n in nodes}
    cover = {i: float(n["stats"][0] if value else sum(n["stats"])) for i, n in by.items()}
    out = []

    def walk(i: int, path: dict[int, tuple[float, float, float]]) -> None:
        n = by[i]
        if n["left"] < 0:
            f = list(path)
            out.append(Leaf(value(n) if value else np.array(n["stats"]) / max(cover[i], 1e-300), f, *(np.array([path[x][j] for x in f]) for j in range(3))))
            return
        lo, hi, z = path.get(n["feature"], (-math.inf, math.inf, 1.0))
        for child, bounds in ((n["left"], (lo, min(hi, n["threshold"]))), (n["right"], (max(lo, n["threshold"]), hi))):
            walk(child, {**path, n["feature"]: (*bounds, z * cover[child] / max(cover[i], 1e-300))})

    walk(0, {})
    return out


def leaf_attributions(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Shapley values [row, path feature] of the game "reaches the leaf", features outside a coalition following the cover."""
    m = len(leaf.features)
    v = x[:, leaf.features]
    one = ((v > leaf.low) & (v <= leaf.high)).astype(float)
    out = np.zeros((len(x), m))
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    for i in range(m):
        poly = np.zeros((len(x), m))
        poly[:, 0] = 1
        for j in range(m):
            if j != i:
                poly[:, 1:] = poly[:, 1:] * leaf.share[j] + poly[:, :-1] * one[:, j, None]
                poly[:, 0] *= leaf.share[j]
        out[:, i] = (one[:, i] - leaf.share[i]) * (poly @ weight)
    return out


def _nodes(model, df: DataFrame) -> list[list[dict]]:
    path = f"{shared_dir(df.sparkSession)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = df.sparkSession.read.parquet(f"{path}/data")
    n = F.col("nodeData")
    flat = rows.select("treeID", n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["impurityStats"].alias("stats"), n["prediction"].alias("prediction"), n["split"]["featureIndex"].alias("feature"), F.get(n["split"]["leftCategoriesOrThreshold"], 0).alias("threshold"))
    trees: dict[int, list[dict]] = {}
    for r in flat.collect():
        trees.setdefault(r["treeID"], []).append(r.asDict())
    return [trees[t] for t in sorted(trees)]


def saved_trees(model, df: DataFrame) -> list[list[Leaf]]:
    """Leaves of every tree of a fitted forest, or of boosted trees per class, read from its saved form: as large as the model.

    A boosted tree gives its class its weighted prediction times the number of all trees, as attributions are means over them.
    """
    if not isinstance(model, OneVsRestModel):
        return [leaves(t) for t in _nodes(model, df)]
    many = sum(len(m.treeWeights) for m in model.models)
    return [leaves(t, lambda n, w=w, c=c: w * n["prediction"] * many * np.eye(len(model.models))[c]) for c, m in enumerate(model.models) for t, w in zip(_nodes(m, df), m.treeWeights, strict=True)]


def row_attributions(trees: list[list[Leaf]], x: np.ndarray, n_features: int) -> np.ndarray:
    """[row, class, feature]: means over trees."""
    classes = len(trees[0][0].value)
    out = np.zeros((len(x), classes, n_features))
    for tree in trees:
        for leaf in tree:
            if leaf.features:
                phi = leaf_attributions(leaf, x)
                out[:, :, leaf.features] += leaf.value[None, :, None] * phi[:, None, :]
    return out / len(trees)


def tree_attributions(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, importance: the mean over rows and classes of absolute attributions; rows have the vector column features.

    The trees are broadcast; each partition returns sums only.
    """
    held = rows.sparkSession.sparkContext.broadcast(saved_trees(model, rows))
    names = list(features)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(names)), 0
        for pdf in frames:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(names))
            for at in range(0, len(x), 2048):
                total += np.abs(row_attributions(held.value, x[at : at + 2048], len(names))).mean(1).sum(0)
            n += len(x)
        yield pd.DataFrame({"feature": names, "s": total, "n": n})

    sums = rows.select(vector_to_array("features").alias("x")).mapInPandas(run, "feature string, s double, n long")
    return sums.groupBy("feature").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("importance"))
