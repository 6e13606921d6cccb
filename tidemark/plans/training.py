"""Fit, cross-validate, calibrate, explain, save and score: one bundle on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans import attribution, encoding, evaluation, features
from tidemark.session import cut_lineage

ID, LABEL, VECTOR, WEIGHT = "user_account_id", "is_churned", "__features", "__weight"


@dataclass
class Recipe:
    """Everything the feature steps learned; the encoding table itself stays a DataFrame."""

    engineered: bool = True
    revenue_median: float | None = None
    density_floor: float | None = None
    frustration: dict[str, list[float]] = field(default_factory=dict)
    skewed: list[str] = field(default_factory=list)
    encoded: list[str] = field(default_factory=list)
    prior: float | None = None
    levels: dict[str, list[str]] = field(default_factory=dict)
    redundant: list[str] = field(default_factory=list)
    order: list[str] = field(default_factory=list)
    fill: dict[str, float] = field(default_factory=dict)


def _derive(df: DataFrame, recipe: Recipe) -> DataFrame:
    """The index is computed before the skew step may replace one of its inputs."""
    if not recipe.engineered:
        return df
    df = features.momentum_features(features.friction_features(df, recipe.revenue_median), recipe.density_floor)
    return df.withColumn("technical_frustration_index", features.frustration_index(recipe.frustration)) if recipe.frustration else df


def _encode(df: DataFrame, recipe: Recipe, table: DataFrame) -> DataFrame:
    df = features.log_transform(df, recipe.skewed)
    df = encoding.one_hot(df, recipe.levels)
    return encoding.apply_target_encoding(df, table, recipe.encoded, recipe.prior)


def fit_recipe(train: DataFrame, label: str = LABEL, key: str = ID, engineered: bool = True) -> tuple[Recipe, DataFrame]:
    recipe = Recipe(engineered=engineered)
    if engineered:
        limits = features.fit_thresholds(train)
        recipe.revenue_median, recipe.density_floor = limits["revenue_median"], limits["density_floor"]
        recipe.frustration = features.fit_frustration(_derive(train, recipe))
    derived = _derive(train, recipe)
    numeric = [f.name for f in derived.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (key, label)]
    recipe.skewed = features.skewed_columns(derived, [c for c in features.ENGAGEMENT_COLUMNS if c in numeric]
                                            if engineered else numeric)
    texts = [f.name for f in derived.schema.fields if isinstance(f.dataType, T.StringType)]
    recipe.levels = encoding.fit_levels(derived, [c for c in features.ONE_HOT if c in texts])
    recipe.encoded = [c for c in (features.TARGET_ENCODED if engineered else texts) if c in texts and c not in recipe.levels]
    table, recipe.prior = encoding.fit_target_encoding(derived, recipe.encoded, label)
    encoded = cut_lineage(_encode(derived, recipe, table))
    candidates = [f.name for f in encoded.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in (key, label)]
    means = encoded.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(candidates)]).first()
    filled = {c: means[f"m{i}"] or 0.0 for i, c in enumerate(candidates)}
    recipe.redundant = encoding.redundant_columns(encoding.correlation_matrix(encoded, candidates), candidates)
    recipe.order = [c for c in candidates if c not in recipe.redundant]
    recipe.fill = {c: filled[c] for c in recipe.order}
    return recipe, table


def apply_recipe(df: DataFrame, recipe: Recipe, table: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The recipe's columns in their order plus the columns to keep, those under a ``keep_`` prefix."""
    kept = df.withColumns({f"keep_{c}": F.col(c) for c in keep if c in df.columns})
    ready = _encode(_derive(kept, recipe), recipe, table)
    columns = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(recipe.fill[c])).alias(c) if c in ready.columns
               else F.lit(0.0).alias(c) for c in recipe.order]
    return ready.select(*[F.col(f"keep_{c}") for c in keep if c in df.columns], *columns)


def model_blueprints(max_iter: int = 20, depth: int = 4, seed: int = 42) -> dict[str, Callable]:
    """Fresh estimators by name. Elastic-net mix and strength of the baseline."""
    common = {"featuresCol": VECTOR, "labelCol": "label", "weightCol": WEIGHT}
    return {
        "elastic_net": lambda: LogisticRegression(elasticNetParam=0.15, regParam=1e-4, maxIter=50, **common),
        "boosted_trees": lambda: GBTClassifier(maxIter=max_iter, maxDepth=depth, seed=seed, **common),
        "random_forest": lambda: RandomForestClassifier(numTrees=max_iter, maxDepth=depth + 2, seed=seed, **common),
    }


def _weighted(df: DataFrame, label: str) -> DataFrame:
    """Weigh positives by the class imbalance."""
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    ratio = counts["n"] / counts["p"] if counts["p"] else 1.0
    return df.withColumns({"label": F.col(label).cast("double"),
                           WEIGHT: F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0))})


def _assembler(order: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=order, outputCol=VECTOR)


def _positive(column: str):
    return vector_to_array(F.col(column))[1]


def fold_scores(df: DataFrame, folds: int = 5, label: str = LABEL, key: str = ID, engineered: bool = True,
                blueprints: Mapping[str, Callable] | None = None) -> Iterator[tuple[str, int, DataFrame]]:
    """Model, fold and the held-out scores (``key``, score, y) of each; features are fitted inside each fold."""
    blueprints = blueprints or model_blueprints()
    dealt = cut_lineage(encoding.stratified_parts(df, label, key, folds, name="fold"))
    for fold in range(folds):
        train, held = dealt.filter(F.col("fold") != fold).drop("fold"), dealt.filter(F.col("fold") == fold).drop("fold")
        recipe, table = fit_recipe(train, label, key, engineered)
        stage = _assembler(recipe.order)
        fit_rows = cut_lineage(stage.transform(_weighted(apply_recipe(train, recipe, table, (label,)), f"keep_{label}")))
        test_rows = stage.transform(apply_recipe(held, recipe, table, (label, key)))
        for name, blueprint in blueprints.items():
            model = blueprint().fit(fit_rows)
            yield name, fold, cut_lineage(model.transform(test_rows).select(
                F.col(f"keep_{key}").alias(key), _positive("probability").alias("score"), F.col(f"keep_{label}").alias("y")))


def cross_validate(df: DataFrame, folds: int = 5, label: str = LABEL, key: str = ID, engineered: bool = True,
                   blueprints: Mapping[str, Callable] | None = None, scores: list[DataFrame] | None = None) -> DataFrame:
    """Average precision and Brier score per model and fold; ``scores``, if given, receives the held-out scores of each."""
    results = []
    for name, fold, scored in fold_scores(df, folds, label, key, engineered, blueprints):
        row = evaluation.curve_summary(scored, "score", "y").first()
        results.append((name, fold, scored.count(), row["average_precision"], row["brier_score"]))
        if scores is not None:
            scores.append(scored.select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), key, "score", "y"))
    return df.sparkSession.createDataFrame(results, "model string, fold int, rows long, average_precision double, brier_score double")


def pick_winner(results: DataFrame) -> str:
    means = results.groupBy("model").agg(F.avg("average_precision").alias("ap"))
    return means.agg(F.max_by("model", F.struct("ap", "model"))).first()[0]


def fit_sigmoid(df: DataFrame, margin: str, label: str) -> tuple[float, float]:
    """Sigmoid calibration with smoothed targets, as one weighted logistic regression on the margin.

    A target strictly between 0 and 1 is a row of each label whose weights share it.
    """
    counts = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    high, low = (counts["p"] + 1.0) / (counts["p"] + 2.0), 1.0 / (counts["n"] + 2.0)
    target = F.when(F.col(label) == 1, F.lit(high)).otherwise(F.lit(low))
    split = df.select(F.col(margin).alias("margin"), F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), target.alias(WEIGHT)),
        F.struct(F.lit(0.0).alias("label"), (1.0 - target).alias(WEIGHT)))))
    vectors = VectorAssembler(inputCols=["margin"], outputCol=VECTOR).transform(split)
    model = LogisticRegression(featuresCol=VECTOR, weightCol=WEIGHT, maxIter=100, tol=1e-10).fit(vectors)
    return float(model.coefficients[0]), float(model.intercept)


def sigmoid(margin: str, slope: float, offset: float):
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * F.col(margin) + F.lit(offset))))


@dataclass
class Bundle:
    """A fitted scoring bundle: recipe, encodings, classifier and calibration."""

    recipe: Recipe
    encodings: DataFrame
    pipeline: PipelineModel
    slope: float
    offset: float
    winner: str

    @property
    def linear(self) -> bool:
        return isinstance(self.pipeline.stages[-1], LogisticRegressionModel)

    @property
    def leaves(self) -> list[dict]:
        return attribution.leaf_table(self.pipeline.stages[-1])

    @property
    def expected_margin(self) -> float:
        """The margin that contributions start from: that of the training means, or of the training cover."""
        model = self.pipeline.stages[-1]
        if self.linear:
            return float(model.intercept) + sum(w * self.recipe.fill[c] for w, c in zip(model.coefficients, self.recipe.order))
        return attribution.expected_margin(self.leaves)

    def explain(self, scored: DataFrame, name: str = "contributions") -> DataFrame:
        if self.linear:
            weights, means = self.pipeline.stages[-1].coefficients, [self.recipe.fill[c] for c in self.recipe.order]
            return scored.withColumn(name, attribution.linear_contributions(self.recipe.order, weights, means))
        return attribution.add_contributions(scored, self.leaves, VECTOR, len(self.recipe.order), name)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/model")
        self.encodings.write.mode("overwrite").parquet(f"{path}/encodings")
        values = {"recipe": asdict(self.recipe), "slope": self.slope, "offset": self.offset, "winner": self.winner}
        spark = self.encodings.sparkSession
        spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        values = json.loads(spark.read.text(f"{path}/parameters").first()[0])
        recipe = Recipe(**values.pop("recipe"))
        return cls(recipe=recipe, encodings=spark.read.parquet(f"{path}/encodings"),
                   pipeline=PipelineModel.load(f"{path}/model"), **values)


def train_bundle(df: DataFrame, label: str = LABEL, key: str = ID, engineered: bool = True, winner: str | None = None,
                 blueprints: Mapping[str, Callable] | None = None, folds: int = 5) -> Bundle:
    """Fit on three quarters of the rows; half of the rest calibrates, the other half stays for evaluation.

    Where no ``winner`` is named, cross-validation inside the training slice picks it.
    """
    blueprints = blueprints or model_blueprints()
    dealt = cut_lineage(with_slices(df, label, key))
    train = dealt.filter(F.col("slice") == "train").drop("slice")
    if winner is None:
        winner = next(iter(blueprints)) if len(blueprints) == 1 else pick_winner(cross_validate(train, folds, label, key, engineered, blueprints))
    recipe, table = fit_recipe(train, label, key, engineered)
    stages = Pipeline(stages=[_assembler(recipe.order), blueprints[winner]()])
    rows = _weighted(apply_recipe(train, recipe, table, (label,)), f"keep_{label}")
    pipeline = stages.fit(cut_lineage(rows))
    calibrating = apply_recipe(dealt.filter(F.col("slice") == "calibrate").drop("slice"), recipe, table, (label,))
    margins = pipeline.transform(calibrating).select(_positive("rawPrediction").alias("margin"), F.col(f"keep_{label}").alias("y"))
    slope, offset = fit_sigmoid(cut_lineage(margins), "margin", "y")
    return Bundle(recipe, table, pipeline, slope, offset, winner)


def with_slices(df: DataFrame, label: str = LABEL, key: str = ID) -> DataFrame:
    """Stratified slices: six eighths train, one calibrates, one evaluates."""
    dealt = encoding.stratified_parts(df, label, key, 8, name="__part")
    name = F.when(F.col("__part") < 6, "train").when(F.col("__part") == 6, "calibrate").otherwise("evaluate")
    return dealt.withColumn("slice", name).drop("__part")


def score(df: DataFrame, bundle: Bundle, keep: tuple[str, ...], explain: bool = True) -> DataFrame:
    """Calibrated probability per row and, if wanted, its contributions and primary driver.

    One narrow pass: lookups of model size are broadcast, nothing is shuffled.
    """
    scored = bundle.pipeline.transform(apply_recipe(df, bundle.recipe, bundle.encodings, keep))
    scored = scored.withColumn("margin", _positive("rawPrediction"))
    columns = [F.col(f"keep_{c}").alias(c) for c in keep if f"keep_{c}" in scored.columns]
    probability = sigmoid("margin", bundle.slope, bundle.offset).alias("probability")
    if not explain:
        return scored.select(*columns, "margin", probability)
    explained = bundle.explain(scored)
    driver = attribution.primary_driver("contributions", bundle.recipe.order).alias("primary_driver")
    return explained.select(*columns, "margin", probability, "contributions", driver)


def fit_personas(df: DataFrame, columns: list[str] | None = None, clusters: int = 3, seed: int = 42) -> PipelineModel:
    """K-means on standardised columns, missing values as 0, run until no centre moves."""
    columns = columns or features.PERSONA_COLUMNS
    inputs = [f"__in_{c}" for c in columns]
    zeros = SQLTransformer(statement="SELECT *, " + ", ".join(f"coalesce(CAST(`{c}` AS DOUBLE), 0.0) AS `{i}`" for c, i in zip(columns, inputs)) + " FROM __THIS__")
    pipeline = Pipeline(stages=[
        zeros, VectorAssembler(inputCols=inputs, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True),
        KMeans(featuresCol="__scaled", predictionCol="persona_cluster", k=clusters, seed=seed, maxIter=200, tol=1e-9)])
    return pipeline.fit(df)


def personas(df: DataFrame, columns: list[str] | None = None, clusters: int = 3, seed: int = 42) -> DataFrame:
    """Add ``persona_cluster``."""
    found = fit_personas(df, columns, clusters, seed).transform(df)
    return found.drop(*[c for c in found.columns if c.startswith("__in_")], "__raw", "__scaled")
