"""Late-payment model (ML-1..ML-8): time-ordered split, gradient boosting or logistic regression, stratified folds.

Training data never leaves Spark: the label and feature frames are DataFrames, the split is a cutoff date (the
(1 - test_size) quantile of issue dates, computed distributed), folds deal each class round robin along a hash order. The
training rows are written once into the shared checkpoint folder and read back, so no fold or tree plans the features again.
For boosting they are binned before the folds are dealt, so that only bytes are sorted.
Boosting grows the trees of all folds and of the final fit together (``boosting``); trees need no scaling, which would
not change a split. Logistic regression is MLlib's, over standardised features, with its folds fitted in parallel. Only
model-sized results (metrics, importances) are small driver-side values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from receivables.functions import expr as E
from receivables.functions.quantile import exact_quantile
from receivables.functions.stored import Run, path_exists, workers_find_package
from receivables.operators import boosting
from receivables.operators.boosting import BoostedTrees
from receivables.operators.features import FEATURE_COLUMNS, customer_sums, engineer_features, late_rows, late_target

FOLD_BUCKET_ROWS = 100_000  # rows of one class that are ranked together


@dataclass
class TrainedModel:
    model: BoostedTrees | PipelineModel
    metrics: DataFrame
    importances: DataFrame
    cv: DataFrame


def training_frame(invoices, customers, payments, as_of, late_threshold_days: int = 7, point_in_time: bool = False,
                   run: Run | None = None) -> DataFrame:
    """Label frame (one row per invoice x payment, D1) with the 25 features; history from all invoices (D15) as of ``as_of``, or
    with ``point_in_time`` as of each invoice's issue date. Labels, history and totals read the same rows, which ``run`` stores."""
    mine = [c for c in ("invoice_id", "customer_id", "issue_date", "due_date", "invoice_amount", "status", "invoice_type", "channel") if c in invoices.columns]
    paid = invoices.select(*mine).join(payments.select("invoice_id", "payment_date", F.col("amount").alias("pay_amount")), "invoice_id", "left")
    paid = run.stored(run.few(paid), "paid") if run else paid
    labelled = late_rows(paid, late_threshold_days).drop("payment_date", "days_late", "pay_amount")
    sums = customer_sums(paid, as_of)
    sums = run.stored(run.few(sums), "customers") if run else sums
    feats = engineer_features(labelled, customers, payments, as_of, history_invoices=invoices, point_in_time=point_in_time, sums=sums)
    return feats.select("invoice_id", "issue_date", "is_late", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS])


def preparation() -> Pipeline:
    """VectorAssembler -> StandardScaler (mean and std)."""
    assembler = VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="raw_features", handleInvalid="keep")
    return Pipeline(stages=[assembler, StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)])


def logistic(n_rows: int, **params) -> LogisticRegression:
    """Logistic regression with the penalty of C = 1 (``regParam`` = 1 / n: MLlib averages the loss)."""
    return LogisticRegression(labelCol="is_late", featuresCol="features", maxIter=params.get("max_iter", 1000),
                              regParam=params.get("reg_param", 1.0 / max(1, n_rows)))


def time_split(frame: DataFrame, test_size: float = 0.25) -> DataFrame:
    """D14: ``is_train`` and the one-row ``cutoff``: rows issued on or before the (1 - test_size) quantile of issue_date
    train, later rows test; rows without an issue date are in neither."""
    days = frame.select(F.unix_date("issue_date").alias("d"))
    cut = exact_quantile(days, "d", 1 - test_size, out="cutoff")
    return frame.where(F.col("issue_date").isNotNull()).crossJoin(F.broadcast(cut)).withColumn("is_train", F.unix_date("issue_date") <= F.col("cutoff"))


def stratified_folds(rows: DataFrame, folds: int, total: int, seed: int = 42, label: str = "is_late", key: str = "invoice_id",
                     counted: DataFrame | None = None) -> DataFrame:
    """``fold``: the rows of each class, in the order of a hash of their key, dealt round robin, so that the folds of a
    class differ by one row at most. A class is ranked in buckets of that hash (about ``FOLD_BUCKET_ROWS`` rows each).
    ``counted``: the same rows from a cheaper source, with their label and key."""
    buckets = max(1, -(-total // FOLD_BUCKET_ROWS))
    h = F.xxhash64(key, F.lit(seed))
    tagged = [df.withColumn("__h", h).withColumn("__bucket", F.pmod("__h", F.lit(buckets)).cast("int")) for df in (rows, rows if counted is None else counted)]
    part = tagged[0]
    before = Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = tagged[1].groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(label, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(label, "__bucket").orderBy("__h", key)
    ranked = part.withColumn("__place", F.row_number().over(inside)).join(F.broadcast(starts), [label, "__bucket"])  # 2 rows per bucket
    fold = F.pmod(F.col("__before") + F.col("__place") - 1, F.lit(folds)).cast("int")
    return ranked.withColumn("fold", fold).drop("__h", "__bucket", "__place", "__before")


def split(invoices, customers, payments, as_of, late_threshold_days: int = 7, test_size: float = 0.25, cv_folds: int = 5,
          seed: int = 42) -> DataFrame:
    """How training divides its rows: per fold and class of the training split the rows, next to the cutoff date, both
    sample sizes and the late rate (%) of all rows."""
    labels = late_target(invoices, payments, late_threshold_days).select("invoice_id", "issue_date", "is_late")
    tagged = time_split(labels, test_size)
    head = tagged.agg(
        F.date_from_unix_date(F.floor(F.first("cutoff")).cast("int")).alias("cutoff_date"),
        F.count_if("is_train").alias("train_samples"), F.count_if(~F.col("is_train")).alias("test_samples"),
        E.round_dec(F.avg("is_late") * 100, 2).alias("late_rate"),
    )
    train_rows = tagged.where("is_train")
    folded = stratified_folds(train_rows.select("invoice_id", "is_late"), cv_folds, train_rows.count(), seed)
    per_fold = folded.groupBy("fold", "is_late").agg(F.count(F.lit(1)).alias("fold_rows"))
    return per_fold.crossJoin(F.broadcast(head)).orderBy("fold", "is_late")


def train(invoices, customers, payments, as_of, model_type: str = "gradient_boost", late_threshold_days: int = 7,
          test_size: float = 0.25, cv_folds: int = 5, seed: int = 42, min_rows: int = 50, trained_at=None,
          point_in_time: bool = False, **params) -> TrainedModel:
    """ML-1..ML-4: fit, cross-validate (ROC AUC mean / std) and report accuracy, late rate and importances."""
    if model_type not in ("gradient_boost", "logistic"):
        raise ValueError(f"Unknown model type: {model_type}")
    spark = invoices.sparkSession
    workers_find_package(spark)
    with Run(spark, "model") as run:
        frame = training_frame(invoices, customers, payments, as_of, late_threshold_days, point_in_time, run).where(F.col("issue_date").isNotNull())
        frame = run.stored(run.few(frame), "frame")
        # Days are few, so the exact quantile comes from rows per day.
        day = F.unix_date("issue_date")
        days = frame.groupBy(day.alias("d")).agg(F.count(F.lit(1)).alias("n"))
        cutoff = days.agg(F.percentile("d", 1 - test_size, F.col("n"))).first()[0]
        is_train = day <= F.lit(cutoff)
        sizes = {r["is_train"]: r for r in frame.groupBy(is_train.alias("is_train")).agg(F.count(F.lit(1)).alias("n"), F.sum("is_late").alias("late")).collect()}
        n_train, n_test = (sizes[k]["n"] if k in sizes else 0 for k in (True, False))
        if n_train + n_test < min_rows:
            raise ValueError(f"Insufficient training data: {n_train + n_test} rows. Need at least {min_rows}.")
        late = sum(r["late"] for r in sizes.values()) / (n_train + n_test)
        fit = fit_boosting if model_type == "gradient_boost" else fit_logistic
        model, train_acc, test_acc, auc, imp = fit(frame.where(is_train), frame.where(~is_train), n_train, n_test, cv_folds, seed, run, **params)
    auc = round(float(np.mean(auc)), 4), round(float(np.std(auc)), 4)
    metrics = spark.createDataFrame(
        [(model_type, n_train, n_test, round(train_acc, 4), round(test_acc, 4), *auc, round(float(late) * 100, 2), late_threshold_days, trained_at)],
        "model_type string, train_samples long, test_samples long, train_accuracy double, test_accuracy double, "
        "cv_roc_auc_mean double, cv_roc_auc_std double, late_rate double, late_threshold_days int, trained_at timestamp_ntz",
    )
    cv_df = spark.createDataFrame([(cv_folds, *auc)], "folds int, cv_roc_auc_mean double, cv_roc_auc_std double")
    importances = spark.createDataFrame(list(zip(FEATURE_COLUMNS, imp)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return TrainedModel(model, metrics, importances, cv_df)


def fit_boosting(train_rows, test_rows, n_train, n_test, folds, seed, run, **params):
    """Boosted trees: model, accuracy on both sides, ROC AUC of each fold, importances."""
    settings = boosting.Settings(seed=seed, **params)
    key = F.xxhash64("invoice_id", F.lit(seed))  # rows of one invoice are sampled together
    rows = train_rows.select(*FEATURE_COLUMNS, F.col("is_late").alias("label"), "invoice_id", key.alias("draw"))
    deal = partial(stratified_folds, folds=folds, total=n_train, seed=seed, label="label", counted=rows.select("label", "invoice_id"))  # of binned rows: a fraction of the bytes
    model, _, margins = boosting.fit(rows, FEATURE_COLUMNS, folds, settings, run, deal)
    right = (F.col("margin") > 0).cast("int") == F.col("label")
    train_acc = margins.where(F.col("margin").isNotNull()).agg(F.avg(right.cast("int"))).first()[0]
    tested = test_rows.select(F.col("is_late").alias("label"), model.margin().alias("margin"))
    test_acc = tested.agg(F.avg(right.cast("int"))).first()[0] if n_test else float("nan")
    # numBins 0: the exact curve over all distinct margins.
    curve = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="cv_margin", metricName="areaUnderROC", numBins=0)
    auc = [curve.evaluate(margins.where(F.col("cv_margin").isNotNull() & (F.col("fold") == f))) for f in range(folds)]
    return model, train_acc, test_acc, auc, model.importances()


def fit_logistic(train_rows, test_rows, n_train, n_test, folds, seed, run, **params):
    """Logistic regression: model, accuracy on both sides, ROC AUC of each fold, absolute coefficients."""
    train_rows = run.stored(stratified_folds(train_rows, folds, n_train, seed), "train")
    prep = preparation().fit(train_rows)
    ready = run.stored(prep.transform(train_rows).select("features", "is_late", "fold"), "vectors").persist()
    cv = CrossValidator(
        estimator=logistic(n_train, **params), estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=BinaryClassificationEvaluator(labelCol="is_late", metricName="areaUnderROC"),
        foldCol="fold", numFolds=folds, parallelism=folds, seed=seed, collectSubModels=True,
    )
    fitted = cv.fit(ready)
    clf = fitted.bestModel  # refit on the whole training split by CrossValidator itself
    auc = [cv.getEvaluator().evaluate(sub[0].transform(ready.where(F.col("fold") == f))) for f, sub in enumerate(fitted.subModels)]
    acc = MulticlassClassificationEvaluator(labelCol="is_late", predictionCol="prediction", metricName="accuracy")
    train_acc = acc.evaluate(clf.transform(ready))
    test_acc = acc.evaluate(clf.transform(prep.transform(test_rows))) if n_test else float("nan")
    ready.unpersist()
    return PipelineModel(stages=[*prep.stages, clf]), train_acc, test_acc, auc, [abs(float(x)) for x in clf.coefficients.toArray()]


def predict_proba(model: BoostedTrees | PipelineModel, features: DataFrame) -> DataFrame:
    """ML-5: p(late) per row (probability of class 1) and risk score p x 100 rounded to 2."""
    feats = features.na.fill(0.0, subset=FEATURE_COLUMNS)
    if isinstance(model, BoostedTrees):
        out = feats.withColumn("p_late", model.probability())
    else:
        out = model.transform(feats).withColumn("p_late", vector_to_array("probability")[1])
    return out.withColumn("risk_score_exact", E.round_dec(F.col("p_late") * 100, 2))


def score_open_invoices(model: BoostedTrees | PipelineModel, invoices, customers, payments, as_of) -> DataFrame:
    """ML-6 with a model: open invoices, history from all invoices (D16), int score (half-even) and category."""
    feats = engineer_features(invoices.where(F.col("status") == "open"), customers, payments, as_of, history_invoices=invoices)
    scored = predict_proba(model, feats)
    return scored.select(
        "invoice_id", "customer_id", "issue_date", "due_date", "invoice_amount", "currency", "status",
        F.bround(F.col("p_late") * 100, 0).cast("int").alias("risk_score"), "p_late",
    ).withColumn("risk_category", E.risk_category("risk_score")).orderBy(F.desc("risk_score"), "invoice_id")


def predict_payment_date(scored: DataFrame, max_delay_days: int = 45) -> DataFrame:
    """ML-7: predicted payment date = due + int(p_late x 45) days, for every scored row."""
    return scored.withColumn(
        "predicted_payment_date", F.date_add("due_date", (F.col("p_late") * max_delay_days).cast("int"))
    )


def save(spark, model: BoostedTrees | PipelineModel, path: str) -> None:
    """ML-8: boosted trees as one JSON row of a Parquet table, a pipeline by MLlib (overwrite)."""
    if isinstance(model, BoostedTrees):
        spark.createDataFrame([(model.to_json(),)], "boosted_trees string").coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.write().overwrite().save(path)


def load(spark, path: str) -> BoostedTrees | PipelineModel:
    if path_exists(spark, f"{path.rstrip('/')}/stages"):
        return PipelineModel.load(path)
    return BoostedTrees.from_json(spark.read.parquet(path).first()["boosted_trees"])
