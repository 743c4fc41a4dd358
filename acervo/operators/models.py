"""Quality classifier, user archetypes, threshold model and their measures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession, functions as F

from acervo.functions.prefix import running_totals
from acervo.functions.sampling import sample_n, split_stratified
from acervo.operators.kmeans import cheapest_fits
from acervo.operators.search import parzen_search
from acervo.session import cut_lineage, spread

#: Most points a silhouette is taken over, and the share of all points where there are more.
SILHOUETTE_SAMPLES, SILHOUETTE_SHARE = 10_000, 0.2
#: Ranges of the forest's settings in the search.
FOREST_SPACE = {"n_estimators": (50, 200), "max_depth": (5, 30), "min_samples_split": (2, 10)}


def feature_columns(df: DataFrame, *skip: str) -> list[str]:
    return [c for c in df.columns if c not in skip]


def balanced_weights(df: DataFrame, label: str = "target") -> DataFrame:
    """Add ``peso``: n / (2 n_class), so both classes weigh the same."""
    n1 = F.sum(label).alias("_n1")
    counts = df.agg(F.count("*").alias("_n"), n1)  # one row
    mine = F.when(F.col(label) == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1"))
    return df.join(F.broadcast(counts)).withColumn("peso", F.col("_n") / (mine * 2)).drop("_n", "_n1")


def train_quality_rf(
    train: DataFrame, label: str = "target", trees: int = 100, depth: int = 10, seed: int = 42
) -> PipelineModel:
    """Random forest with balanced class weights over all other columns but ``id``."""
    columns = feature_columns(train, "id", label, "split")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, weightCol="peso", numTrees=trees, maxDepth=depth, seed=seed,
        cacheNodeIds=True,  # else every task of every level gets all trees so far and runs its rows through them
    )
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), forest]
    return Pipeline(stages=stages).fit(spread(balanced_weights(train, label), "id"))


def predict_quality(model: PipelineModel | None, features: DataFrame) -> DataFrame:
    """(id, probabilidade, previsto[, target]) of each game."""
    if model is None:
        raise ValueError("the model is not trained")
    out = model.transform(features).withColumn("probabilidade", vector_to_array("probability")[1])
    keep = ["id", "probabilidade", F.col("prediction").cast("int").alias("previsto")]
    return out.select(*keep, *([F.col("target")] if "target" in features.columns else []))


def save_model(model: PipelineModel | None, path: str) -> None:
    if model is None:
        raise ValueError("the model is not trained")
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """Raises FileNotFoundError where no model is saved."""
    spark = SparkSession.getActiveSession()
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
        raise FileNotFoundError(path)
    return PipelineModel.load(path)


def pr_curve(scored: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Precision and recall at every distinct score taken as threshold."""
    cells = scored.groupBy(F.col(score).alias("limiar")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n")
    ).withColumn("_desc", -F.col("limiar"))
    run = running_totals(cells, "_desc", ["pos", "n"])
    tp, taken = F.col("pos_before") + F.col("pos"), F.col("n_before") + F.col("n")
    return run.select(
        "limiar",
        (tp / taken).alias("precision"),
        F.try_divide(tp, F.col("pos_total")).alias("recall"),
        F.try_divide(F.col("pos"), F.col("pos_total")).alias("passo"),
    )


def average_precision(scored: DataFrame, label: str = "y", score: str = "score") -> DataFrame:
    """Area under the step-wise precision-recall curve."""
    return pr_curve(scored, label, score).agg(
        F.coalesce(F.sum(F.col("passo") * F.col("precision")), F.lit(0.0)).alias("ap")
    )


def threshold_report(
    scored: DataFrame, thresholds: Sequence[float] = (0.3, 0.5, 0.7), label: str = "y", score: str = "score"
) -> DataFrame:
    """Confusion counts, precision, recall and F1 per threshold, in one pass."""
    good, aggs = F.col(label) == 1, []
    for i, t in enumerate(thresholds):
        yes = F.col(score) >= t
        aggs += [
            F.count_if(yes & good).alias(f"tp{i}"),
            F.count_if(yes & ~good).alias(f"fp{i}"),
            F.count_if(~yes & good).alias(f"fn{i}"),
            F.count_if(~yes & ~good).alias(f"tn{i}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(t).alias("limiar"), *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "fn", "tn")])
        for i, t in enumerate(thresholds)
    ])
    zero = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        scored.agg(*aggs)
        .select(F.inline(rows))
        .withColumn("precision", F.coalesce(F.try_divide(tp, tp + fp), zero))
        .withColumn("recall", F.coalesce(F.try_divide(tp, tp + fn), zero))
        .withColumn("f1", F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero))
    )


def pca_95(df: DataFrame, key: str, keep: float = 0.95) -> tuple[DataFrame, PipelineModel]:
    """Standardised features projected on the fewest components holding ``keep`` of the variance."""
    columns = feature_columns(df, key)
    df = cut_lineage(df)  # one narrow row per key, read by every fit
    prepare = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True),
        PCA(k=len(columns), inputCol="_std", outputCol="_pca"),
    ]).fit(df)
    total, n = 0.0, 0
    for share in prepare.stages[2].explainedVariance.toArray():
        total, n = total + share, n + 1
        if total >= keep:
            break
    cut = VectorSlicer(inputCol="_pca", outputCol="features", indices=list(range(n)))
    model = PipelineModel(stages=[*prepare.stages, cut])
    return model.transform(df).select(key, "features"), model


def silhouette_sample(points: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All points, or a seeded sample where there are more than SILHOUETTE_SAMPLES."""
    n = points.count()
    if n <= SILHOUETTE_SAMPLES:
        return points
    return sample_n(points, int(min(SILHOUETTE_SAMPLES, n * SILHOUETTE_SHARE)), key, seed)


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette by Euclidean distances among the rows (features, prediction); 0 for a cluster of one point."""
    return silhouettes(labelled, ["prediction"])[0]


def silhouettes(labelled: DataFrame, labels: Sequence[str]) -> list[float]:
    """The silhouette by each column of labels; distances are worked out once for all.

    The rows are a sample of bounded size (see silhouette_sample): all of them go to
    every task, where a block of them meets all clusters.
    """
    rows = labelled.select(vector_to_array("features").alias("x"), F.array(*[F.col(c).cast("int") for c in labels]).alias("c"))
    found = rows.limit(SILHOUETTE_SAMPLES + 1).collect()
    if len(found) > SILHOUETTE_SAMPLES:
        raise ValueError(f"a silhouette is taken over at most {SILHOUETTE_SAMPLES} points")
    if not found:
        return [0.0] * len(labels)
    each = [np.unique([r["c"][i] for r in found], return_inverse=True) for i in range(len(labels))]
    shared = labelled.sparkSession.sparkContext.broadcast((np.array([r["x"] for r in found], np.float64), each))

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, each = shared.value
        members = [np.eye(len(names))[label] for names, label in each]
        for batch in batches:
            total, column = np.zeros(len(each)), batch.column("x")
            mine = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            own = batch.column("c").flatten().to_numpy().reshape(len(column), -1)
            for start in range(0, len(mine), 256):
                block = mine[start : start + 256]
                apart = np.zeros((len(block), len(points)))
                for axis in range(points.shape[1]):
                    step = block[:, axis][:, None] - points[None, :, axis]
                    step *= step
                    apart += step
                np.sqrt(apart, out=apart)
                at = np.arange(len(block))
                for i, (member, (names, _)) in enumerate(zip(members, each)):
                    here = np.searchsorted(names, own[start : start + 256, i])
                    size, sums = member.sum(axis=0), apart @ member
                    inside = sums[at, here] / np.maximum(size[here] - 1, 1)
                    means = sums / size
                    means[at, here] = np.inf
                    outside = means.min(axis=1)
                    wide = np.where(size[here] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
                    total[i] += float(np.where(np.isfinite(outside), wide, 0.0).sum())
            yield pa.RecordBatch.from_pydict({"s": pa.array([total], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(widths, "s array<double>").agg(*[F.sum(F.col("s")[i]) for i in range(len(labels))]).first()
    return [s / len(found) for s in sums]


def best_kmeans(
    points: DataFrame, low: int = 3, high: int = 10, seed: int = 42, starts: int = 10, key: str = "usuario_id", parallelism: int = 8
) -> tuple[KMeansModel, float]:
    """The k with the best silhouette, each k at the cheapest of several starts; equal scores go to the smaller k."""
    points = spread(points, key)  # every fit iterates over the points
    judged = silhouette_sample(points, key, seed)  # the same points for every k
    judged = cut_lineage(judged.repartition(points.sparkSession.sparkContext.defaultParallelism, key))
    best, score = None, -2.0
    cheapest = cheapest_fits(points, range(low, high + 1), [seed + i for i in range(starts)], parallelism)
    for k, model in cheapest.items():
        judged = model.transform(judged, {model.predictionCol: f"_c{k}"})
    for model, now in zip(cheapest.values(), silhouettes(judged, [f"_c{k}" for k in cheapest]), strict=True):
        if now > score:
            best, score = model, now
    return best, score


def user_clusters(features: DataFrame, key: str = "usuario_id", low: int = 3, high: int = 10) -> tuple[DataFrame, int, float]:
    """(usuario_id, cluster), the chosen k and its silhouette."""
    points, _ = pca_95(features, key)
    model, score = best_kmeans(points, low, high, key=key)
    out = model.transform(points).select(key, F.col("prediction").alias("cluster"))
    return out, model.getK(), score


def threshold_dataset(condition: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """User conditions with their best threshold, split 70/10/20 within each threshold."""
    rows = condition.join(targets, "usuario_id").where("best_threshold IS NOT NULL")
    return split_stratified(rows, "usuario_id", ["best_threshold"], 0.2, 0.125, seed)


def train_threshold_model(train: DataFrame, seed: int = 42) -> PipelineModel:
    columns = feature_columns(train, "usuario_id", "best_threshold", "best_precision", "split")
    return Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="features"),
        GBTRegressor(featuresCol="features", labelCol="best_threshold", maxIter=20, maxDepth=4, seed=seed),
    ]).fit(train)


def predict_threshold(model: PipelineModel, condition: DataFrame) -> DataFrame:
    """Threshold per user, kept within 0.25 .. 0.85."""
    guess = F.greatest(F.lit(0.25), F.least(F.lit(0.85), F.col("prediction")))
    out = model.transform(condition).withColumn("limiar", guess)
    keep = ["usuario_id", "limiar"] + [c for c in ("best_threshold", "split") if c in condition.columns]
    return out.select(*keep)


def threshold_error(predicted: DataFrame) -> DataFrame:
    """Mean absolute error per split."""
    return predicted.groupBy("split").agg(
        F.avg(F.abs(F.col("limiar") - F.col("best_threshold"))).alias("mae"), F.count("*").alias("n")
    )


def tune_rf(
    train: DataFrame, label: str = "target", trials: int = 20, seed: int = 42, parallelism: int = 4
) -> DataFrame:
    """Search over forest settings for the precision of the positive class, best first.

    Trials run in rounds of ``parallelism``, each round where the trials before it promise most (see ``search``). The
    history is returned whole: trial, rodada, the settings, precision. All trials are judged on the same held-out fifth.
    """
    columns = feature_columns(train, "id", label, "split")
    vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(train)
    rows = spread(vectors.select("id", "features", label), "id").drop("id")  # read by every trial
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, cacheNodeIds=True)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="precisionByLabel", metricLabel=1.0)

    def precision(settings: list[dict[str, int]]) -> list[float]:
        grid = [
            {
                forest.numTrees: s["n_estimators"],
                forest.maxDepth: s["max_depth"],
                # a node of fewer rows than this must not split: its parts would fall below half of it
                forest.minInstancesPerNode: max(1, s["min_samples_split"] // 2),
            }
            for s in settings
        ]
        found = TrainValidationSplit(
            estimator=forest, estimatorParamMaps=grid, evaluator=judge, trainRatio=0.8, parallelism=parallelism, seed=seed
        ).fit(rows)
        return [float(m) for m in found.validationMetrics]

    history = parzen_search(FOREST_SPACE, precision, trials, first=2 * parallelism, per_round=parallelism, seed=seed)
    out = [(h["trial"], h["round"], *(h[name] for name in FOREST_SPACE), h["score"]) for h in history]
    settings = ", ".join(f"{name} int" for name in FOREST_SPACE)
    return train.sparkSession.createDataFrame(out, f"trial int, rodada int, {settings}, precision double").orderBy(F.desc("precision"), "trial")
