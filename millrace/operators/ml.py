"""Baseline models with pyspark.ml, and relevance of features by mutual information."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import names as N
from .analysis import numeric_columns
from .neighbours import CLASSES, neighbour_information
from .profile import TableProfile, logical_type

MAX_CATEGORIES, REGRESSION_DISTINCT, MIN_ROWS = 50, 15, 10
#: Rows of a task in training; forests hold theirs with a number for each tree and feature.
TASK_ROWS = 50_000


def task_type(df: DataFrame, target: str) -> str:
    """regression for a number with more than 15 values, else classification."""
    if target in numeric_columns(df) and df.agg(F.count_distinct(target)).first()[0] > REGRESSION_DISTINCT:
        return "regression"
    return "classification"


def choose_features(df: DataFrame, target: str, features: list[str] | None = None) -> tuple[list[str], list[str], list[str]]:
    """(numeric, categorical, dropped): id-like names and wide categories are left out unless asked for."""
    names = features or [c for c in df.columns if c != target and not N.looks_like_id(c)]
    numbers = [c for c in names if c in numeric_columns(df) and c != target]
    rest = [c for c in names if c not in numbers and c != target and df.schema[c].dataType.typeName() in ("string", "boolean")]
    if not rest:
        return numbers, [], []
    d = df.agg(*[F.count_distinct(c).alias(c) for c in rest]).first()
    kept = [c for c in rest if features or d[c] <= MAX_CATEGORIES]
    return numbers, kept, [c for c in rest if c not in kept]


def split_rows(df: DataFrame, target: str, key: str | None = None, test: float = 0.2, seed: int = 42, stratify: bool = True) -> DataFrame:
    """``df`` with _test: a fifth by a seeded hash, within each class where there are classes."""
    h = F.xxhash64(*([key] if key else df.columns), F.lit(seed))
    if not stratify:
        return df.withColumn("_test", F.pmod(h, F.lit(1000)) < int(test * 1000))
    # The hash cuts every class alike; a class is never gathered in one task.
    return df.withColumn("_test", F.pmod(F.xxhash64(h, target), F.lit(1000)) < int(test * 1000))


def _fitted(numbers: list[str], categories: list[str], model, data: DataFrame, rows: int) -> PipelineModel:
    """Preparation and forest; the forest's rows are dealt to tasks of ``TASK_ROWS``, as one file or row group may else be one task that grows with the table."""
    stages = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"_n_{c}" for c in numbers], strategy="median"))
    if categories:
        stages.append(StringIndexer(inputCols=[f"_s_{c}" for c in categories], outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_o_{c}" for c in categories], dropLast=False, handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"_n_{c}" for c in numbers] + [f"_o_{c}" for c in categories], outputCol="_features"))
    prepared = Pipeline(stages=stages).fit(data)
    vectors = prepared.transform(data).select("_label", "_features", *[c for c in data.columns if c == "_weight"])
    return PipelineModel([*prepared.stages, model.fit(vectors.repartition(max(1, -(-rows // TASK_ROWS))))])


def _typed(df: DataFrame, numbers: list[str], categories: list[str]) -> DataFrame:
    out = df.withColumns({c: F.col(c).cast("double") for c in numbers})
    return out.withColumns({f"_s_{c}": F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categories}) if categories else out


def _importances(fitted, numbers: list[str], categories: list[str], top: int = 10) -> list[dict]:
    forest = fitted.stages[-1]
    names = [f"numerical__{c}" for c in numbers]
    indexer = next((s for s in fitted.stages if hasattr(s, "labelsArray")), None)
    if indexer:
        for c, labels in zip(categories, indexer.labelsArray):
            names += [f"categorical__{c}_{v}" for v in [*labels, "other", "none"]]
    found = sorted(zip(names, forest.featureImportances.toArray().tolist()), key=lambda x: -x[1])
    return [{"feature": n, "importance": round(v, 4)} for n, v in found[:top] if v > 0]


def train_model(df: DataFrame, target: str, task: str | None = None, features: list[str] | None = None, *, trees: int = 100, seed: int = 42) -> dict:
    """A random forest with an 80/20 split: metrics, importances, label mapping."""
    rows = df.filter(F.col(target).isNotNull())
    n = rows.count()
    if n < MIN_ROWS:
        return {"error": f"Not enough rows to train: {n}"}
    task = task or task_type(rows, target)
    numbers, categories, dropped = choose_features(rows, target, features)
    if not numbers + categories:
        return {"error": "No usable feature columns."}
    data = split_rows(_typed(rows, numbers, categories), target, stratify=task == "classification")
    out = {"task_type": task, "target_column": target, "rows_used": n, "note": "Baseline random forest; not tuned."}
    if dropped:
        out["dropped_high_cardinality_columns"] = dropped
    if task == "classification":
        labels = [r[0] for r in data.select(F.col(target).cast("string")).distinct().orderBy(target).limit(1001).collect()]
        if not 2 <= len(labels) <= 1000:
            return {"error": f"Target '{target}' has {len(labels)} classes."}
        indexer = StringIndexer(inputCol="_y", outputCol="_label", stringOrderType="alphabetAsc").fit(data.withColumn("_y", F.col(target).cast("string")))
        data = indexer.transform(data.withColumn("_y", F.col(target).cast("string")))
        sizes = {r["_label"]: r["count"] for r in data.filter("not _test").groupBy("_label").count().collect()}
        total = sum(sizes.values())
        weight = F.coalesce(*[F.when(F.col("_label") == k, F.lit(total / (len(sizes) * v))) for k, v in sizes.items()])
        data = data.withColumn("_weight", weight)
        model = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", numTrees=trees, seed=seed)
    else:
        data = data.withColumn("_label", F.col(target).cast("double"))
        model = RandomForestRegressor(featuresCol="_features", labelCol="_label", numTrees=trees, seed=seed)
    train, test = data.filter("not _test"), data.filter("_test")
    fitted = _fitted(numbers, categories, model, train, n)
    scored = fitted.transform(test).cache()
    try:
        if task == "classification":
            ev = lambda m: round(MulticlassClassificationEvaluator(labelCol="_label", metricName=m).evaluate(scored), 4)
            out["metrics"] = {"accuracy": ev("accuracy"), "precision": ev("weightedPrecision"), "recall": ev("weightedRecall"), "f1": ev("f1")}
            out["metrics"]["confusion_matrix"] = [r.asDict() for r in scored.groupBy("_label", "prediction").count().orderBy("_label", "prediction").collect()]
            out["label_mapping"] = {k: v for k, v in enumerate(indexer.labels)}
        else:
            ev = lambda m: round(RegressionEvaluator(labelCol="_label", metricName=m).evaluate(scored), 4)
            out["metrics"] = {"mae": ev("mae"), "mse": ev("mse"), "rmse": ev("rmse"), "r2": ev("r2")}
        test_rows = scored.count()
    finally:
        scored.unpersist()
    return out | {"train_rows": n - test_rows, "test_rows": test_rows, "top_features": _importances(fitted, numbers, categories)}


def analyze_churn(df: DataFrame, *, trees: int = 100, seed: int = 42) -> dict:
    """Churn rate and what drives it; the column is named churn in any case."""
    name = next((c for c in df.columns if c.lower() == "churn"), None)
    if name is None:
        return {"error": "No 'churn' column found."}
    rows = df.withColumn("_y", C.churn_label(F.col(name))).filter("_y is not null")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"), F.sum("_y").alias("s")).first()
    if not r["n"] or r["s"] in (0, r["n"]):
        return {"error": "The churn column needs both values."}
    numbers, categories, _ = choose_features(rows.drop("_y"), name)
    weight = F.when(F.col("_y") == 1, F.lit(r["n"] / (2 * r["s"]))).otherwise(F.lit(r["n"] / (2 * (r["n"] - r["s"]))))
    data = _typed(rows, numbers, categories).withColumn("_label", F.col("_y").cast("double")).withColumn("_weight", weight)
    model = RandomForestClassifier(featuresCol="_features", labelCol="_label", weightCol="_weight", numTrees=trees, seed=seed)
    fitted = _fitted(numbers, categories, model, data, r["n"])
    return {"rows_used": r["n"], "churn_rate_percent": round(100 * r["rate"], 2), "top_features": _importances(fitted, numbers, categories)}


# -- relevance -------------------------------------------------------------------------


def binned(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """``df`` with numbers as the number of their quantile bin and everything else as text."""
    numbers = [c for c in columns if c in numeric_columns(df)]
    out = df
    if numbers:
        cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(c) for c in numbers]).first()
        for c in numbers:
            edges = sorted(set(cuts[c] or []))
            out = out.withColumn(c, sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges), F.lit(0)).cast("string"))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns})


def mutual_information(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, mi) in nats of text columns with a target, from one aggregate of joint counts."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in columns]
    joint = df.select(F.col(target).alias("y"), F.inline(F.array(*rows))).groupBy("column", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("column"))
    px = F.sum("n").over(Window.partitionBy("column", "x"))
    py = F.sum("n").over(Window.partitionBy("column", "y"))
    terms = joint.select("column", "n", total.alias("t"), px.alias("px"), py.alias("py"))
    return terms.groupBy("column").agg(F.round(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("px") * F.col("py")))), 6).alias("mi"))


def assess_feature_relevance(df: DataFrame, p: TableProfile, goal: str | None = None, target: str | None = None) -> dict:
    """Features in three bands, by mutual information with a target or, without one, by structure."""
    words = set(N.tokens((goal or "").replace(" ", "_")))
    names = [c for c in df.columns if c != target]
    scores: dict[str, float] = {}
    if target:
        wide = [c for c in names if p.columns[c].logical_type == "text" and p.columns[c].distinct > MAX_CATEGORIES]
        used = [c for c in names if c not in wide]
        known = df.filter(F.col(target).isNotNull())
        continuous = [c for c in used if c in numeric_columns(df)] if target not in numeric_columns(df) or p.columns[target].distinct <= CLASSES else used
        counted = [c for c in used if c not in continuous]
        mi = {r["column"]: r["mi"] for r in neighbour_information(known, continuous, target).collect()} if continuous else {}
        mi |= {r["column"]: r["mi"] for r in mutual_information(binned(known, [*counted, target]), counted, target).collect()} if counted else {}
        most = max(mi.values(), default=0.0) or 1.0
        scores = {c: mi.get(c, 0.0) / most for c in names}
    else:
        for c in names:
            k = p.columns[c]
            base = 0.7 if k.logical_type == "numeric" and not k.constant else 0.6 if k.distinct <= MAX_CATEGORIES else 0.2
            scores[c] = base * (1 - k.missing_percent / 100)
    ranking = []
    for c, s in scores.items():
        k = p.columns[c]
        bonus = 0.15 if words & set(N.tokens(c)) else 0.0
        penalty = 1.0 if k.constant else 0.8 if k.id_candidate or N.is_artifact(c) else 0.5 if k.missing_percent >= 50 else 0.0
        ranking.append({"column": c, "score": round(max(0.0, min(1.0, s + bonus - penalty)), 4)})
    ranking.sort(key=lambda r: (-r["score"], r["column"]))
    band = lambda lo, hi: [r["column"] for r in ranking if lo <= r["score"] < hi]
    return {
        "status": "success", "goal": goal, "target_column": target, "method": "mutual_information" if target else "structural",
        "highly_relevant": band(0.6, 9), "potentially_relevant": band(0.3, 0.6), "low_relevance": band(-1, 0.3), "ranking": ranking,
        "note": "Scores are relative to the best feature.",
    }


__all__ = ["analyze_churn", "assess_feature_relevance", "binned", "choose_features", "logical_type", "mutual_information", "split_rows", "task_type", "train_model"]
