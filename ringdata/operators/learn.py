"""Metrics, splits and models (A26-A33, W3, W4, W12, M1-M10, X6). Scores are statistical, not proof."""

from __future__ import annotations

import json
import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringdata.functions import scalars as S
from ringdata.operators.edges import uniform
from ringdata.operators.order import quantile, running_sums
from ringdata.operators.profiles import FEATURES
from ringdata.sources.tables import cut

# Features on a log scale, and the columns that explain a prediction.
LOG_FEATURES = [
    "cdr_events_total", "cdr_direction_min_count", "cdr_direction_max_count", "cdr_total_duration_seconds", "cdr_mean_duration_seconds", "cdr_max_duration_seconds", "cdr_duration_std_seconds",
    "cdr_active_days", "cdr_activity_span_days", "cdr_events_per_active_day", "cdr_degree_min", "cdr_degree_max", "cdr_common_contacts", "ipdr_session_count_min", "ipdr_session_count_max",
    "ipdr_total_mb_min", "ipdr_total_mb_max", "ipdr_active_days_min", "ipdr_active_days_max",
]
EVIDENCE_COLUMNS = [
    "cdr_has_direct_interaction", "cdr_events_total", "cdr_reciprocity_ratio", "cdr_total_duration_seconds", "cdr_active_days", "cdr_common_contacts", "cdr_contact_jaccard", "ipdr_both_people_present",
    "ipdr_hour_cosine_similarity", "ipdr_destination_jaccard", "ipdr_port_jaccard", "ipdr_time_bucket_jaccard",
]
# Our values: trust in each source of labels.
LABEL_WEIGHTS = {"confirmed": 1.0, "observed": 1.0, "inferred": 0.4, "sampled_negative": 0.6}
WARNING = "scores are statistical estimates, not proof of a relationship"


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def binary_metrics(df: DataFrame, label: str = "label", p: str = "p", threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """A26 (A32 with by=['source']): confusion counts and rates, 0 where a denominator is 0; macro_f1 over both classes."""
    y, s = F.col(label) == 1, F.col(p) >= threshold
    counted = df.groupBy(*(by or [])).agg(F.count_if(y & s).alias("tp"), F.count_if(~y & s).alias("fp"), F.count_if(~y & ~s).alias("tn"), F.count_if(y & ~s).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    return counted.select(
        "*", _div(tp + tn, tp + fp + tn + fn).alias("accuracy"), _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"), f1.alias("f1"), _div(tn, tn + fp).alias("specificity"), ((f1 + f0) / 2).alias("macro_f1"),
    )


def _by_score(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row per distinct score, at full precision: positives, negatives and those of higher scores; rows without a score do not count."""
    known = df.where(F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double")))
    rows = known.groupBy(F.col(p).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return running_sums(rows, [F.col("s").desc()], ["pos", "neg"]).withColumnsRenamed({"before_pos": "pos_above", "before_neg": "neg_above"})


def roc_auc(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Rank AUC, ties counting half; null with one class."""
    r = _by_score(df, label, p).agg(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return r.select(F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / F.col("n1") / F.col("n0")).alias("auc"))


def average_precision(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """The sum of precision times the step of recall over distinct scores."""
    r = _by_score(df, label, p)
    tp, n = F.col("pos_above") + F.col("pos"), F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")
    return r.agg(F.sum(F.col("pos") * tp / n).alias("u"), F.sum("pos").alias("n1")).select(F.when(F.col("n1") > 0, F.col("u") / F.col("n1")).alias("average_precision"))


def threshold_table(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """Metrics at the 181 thresholds 0.050, 0.055, ..., 0.950, from counts per threshold step (one pass over df)."""
    step = F.least(F.lit(181), F.greatest(F.lit(0), F.floor((F.col(p) - 0.05) / 0.005 + 1e-9) + 1)).cast("int")
    counts = df.groupBy(step.alias("step")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    steps = df.sparkSession.range(182).select(F.col("id").cast("int").alias("step")).join(counts, "step", "left").fillna(0)
    down, every = Window.orderBy(F.col("step").desc()), Window.partitionBy()  # 182 rows
    rows = steps.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "n1": F.sum("pos").over(every), "n0": F.sum("neg").over(every)}).where("step > 0")
    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("n1") - F.col("tp"), F.col("n0") - F.col("fp")
    f1, f0 = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fp + fn)
    return rows.select(
        F.round(F.lit(0.05) + (F.col("step") - 1) * 0.005, 3).alias("threshold"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1"), ((_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


def best_threshold(df: DataFrame, label: str = "label", p: str = "p", strategy: str = "f1") -> DataFrame:
    """The threshold of the highest value; ties: nearest to 0.5, then the greater. Strategies: f1, macro_f1, balanced_accuracy, fixed_0_5."""
    table = threshold_table(df, label, p)
    if strategy == "fixed_0_5":
        return table.where("threshold = 0.5").select("threshold", F.col("f1").alias("value"))
    best = table.agg(F.max(F.struct(F.round(strategy, 12).alias("value"), (-F.round(F.abs(F.col("threshold") - 0.5), 3)).alias("near"), "threshold")).alias("b"))
    return best.select("b.threshold", "b.value")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """A29."""
    c = df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"))
    return c.withColumn("pos_weight", F.greatest("negatives", F.lit(1)) / F.greatest("positives", F.lit(1)))


def transformed(columns: list[str]) -> list[Column]:
    """F21 on the log features; non-finite values count as 0."""
    x = lambda c: S.safe_number(F.col(c))
    return [(S.log1p_clip(x(c)) if c in LOG_FEATURES else x(c)).alias(c) for c in columns]


def feature_scaler(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Feature, mean and population standard deviation (below 1e-8: 1) after transformed()."""
    t = df.select(*transformed(columns))
    one = t.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for c in columns])))
    return rows.select("feature", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.when(F.col("std") >= 1e-8, F.col("std")).otherwise(1.0).alias("std"))


def transform_features(df: DataFrame, scaler: dict[str, tuple[float, float]], columns: list[str] = FEATURES) -> DataFrame:
    """M1: scaled features; the scaler is one (mean, std) per feature, fitted on the training split only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing features {missing}")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, *[((c_ - scaler[c][0]) / scaler[c][1]).alias(c) for c, c_ in zip(columns, transformed(columns), strict=True)])


def scaler_of(table: DataFrame) -> dict[str, tuple[float, float]]:
    return {r.feature: (r["mean"], r["std"]) for r in table.collect()}  # one row a feature


def stratified_split(df: DataFrame, key: list[str], label: str = "label", seed: int = 42, fraction: float = 0.2) -> DataFrame:
    """Df with `split`: per class max(1, round(fraction * n)) test and as many validation rows, by hash order, at least 1 train row.

    Ranks come from per-block counts (256 blocks of the hash), so a class is never one task.
    Only the rows of blocks in which a split ends, two of a class, are ranked and shuffled.
    """
    u = F.xxhash64(F.lit(seed), *key)
    rows = df.drop("split").withColumns({"_u": u, "_b": F.shiftrightunsigned(u, 56).cast("int")})
    counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a class
    offsets = counts.select(label, "_b", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"), F.sum("n").over(Window.partitionBy(label)).alias("_n"))
    part = F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("int"))
    part = F.when(F.col("_n") - 2 * part >= 1, part).otherwise(F.greatest(F.lit(1), F.floor((F.col("_n") - 1) / 2)))
    split = lambda k: F.when(k <= F.col("_part"), "test").when(k <= 2 * F.col("_part"), "validation").otherwise("train")
    first, last = split(F.col("_o") + 1), split(F.col("_o") + F.col("n"))
    blocks = offsets.withColumn("_part", part).select(label, "_b", "_o", "_part", F.when(first == last, first).alias("split"))
    placed = rows.join(F.broadcast(blocks), [label, "_b"])
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", *key)) + F.col("_o")
    whole, cut_ = placed.where("split IS NOT NULL"), placed.where("split IS NULL").withColumn("split", split(rank))
    return whole.unionByName(cut_).drop("_u", "_b", "_o", "_part")


def group_disjoint_split(df: DataFrame, a: str, b: str, seed: int = 42, shares=(0.6, 0.2, 0.2)) -> DataFrame:
    """Each person belongs to one split by hash; pairs of people of two splits are dropped."""
    of = lambda c: F.when(uniform(seed, F.col(c)) < shares[0], "train").when(uniform(seed, F.col(c)) < shares[0] + shares[1], "validation").otherwise("test")
    return df.withColumns({"split": of(a), "_other": of(b)}).where("split = _other").drop("_other")


def temporal_split(df: DataFrame, ts: str, held: float = 0.2) -> DataFrame:
    """Rows later than the (1 - held) quantile of time, which is exact, are held out."""
    q = quantile(df, F.unix_micros(ts), 1 - held)
    return df.join(F.broadcast(q), F.lit(True)).withColumn("split", F.when(F.unix_micros(ts) > F.col("q"), "held_out").otherwise("train")).drop("q")  # q is one row


def review_errors(df: DataFrame, kind: str, limit: int, threshold: float = 0.5, key: str = "id") -> DataFrame:
    """The false positives of the highest p or the false negatives of the lowest."""
    if kind == "false_positive":
        return df.where((F.col("label") == 0) & (F.col("p") >= threshold)).orderBy(F.col("p").desc(), key).limit(limit)
    return df.where((F.col("label") == 1) & (F.col("p") < threshold)).orderBy("p", key).limit(limit)


def label_source_counts(df: DataFrame) -> DataFrame:
    """Rows and classes per source."""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def label_policy_weights(df: DataFrame, policy: str = "all_weighted") -> DataFrame:
    """M8: df with `weight`; observed_only and confirmed_only keep those sources (negatives that were sampled stay)."""
    keep = {"all_weighted": list(LABEL_WEIGHTS), "observed_only": ["observed", "confirmed", "sampled_negative"], "confirmed_only": ["confirmed", "sampled_negative"]}[policy]
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in LABEL_WEIGHTS.items()], F.lit(0.0))
    return df.where(F.col("source").isin(keep)).withColumn("weight", weight)


def training_preconditions(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Ok and its parts: at least 10 pairs, 3 of each class, all features finite, not all zero."""
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in columns), F.lit(0))
    some = sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in columns), F.lit(0))
    c = df.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), F.coalesce(F.sum(bad), F.lit(0)).alias("not_finite"), F.coalesce(F.sum(some), F.lit(0)).alias("not_zero"))
    ok = (F.col("pairs") >= 10) & (F.col("positives") >= 3) & (F.col("negatives") >= 3) & (F.col("not_finite") == 0) & (F.col("not_zero") > 0)
    return c.withColumn("ok", ok)


class PairModel:
    """A fitted classifier with its features, scaler and threshold (M2, M3, M5, M6)."""

    def __init__(self, model: PipelineModel, scaler: dict, threshold: float, columns: list[str]):
        self.model, self.scaler, self.threshold, self.columns = model, scaler, threshold, columns

    def score(self, df: DataFrame, all_features: bool = False) -> DataFrame:
        """M3: keys, probability, label text, threshold and evidence columns of every pair."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing features {missing}")
        keys = [c for c in df.columns if c not in self.columns]
        kept = self.columns if all_features else [c for c in EVIDENCE_COLUMNS if c in self.columns]
        raw = df.select(*keys, F.struct(*kept).alias("_raw"), *self.columns)
        out = self.model.transform(transform_features(raw, self.scaler, self.columns))
        p = vector_to_array("probability")[1]
        return out.select(*keys, p.alias("p"), S.prediction_text(p, self.threshold).alias("prediction"), F.lit(self.threshold).alias("threshold"), "_raw.*", F.lit(WARNING).alias("note"))

    def importance(self, spark) -> DataFrame:
        """M5: |coefficient| normalized to 1 (a tree model: its importances)."""
        last = self.model.stages[-1]
        values = [abs(x) for x in (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()]
        total = sum(values) or 1.0
        return spark.createDataFrame([(c, float(v / total)) for c, v in zip(self.columns, values, strict=True)], "feature string, importance double").orderBy(F.col("importance").desc(), "feature")

    def save(self, path: str) -> None:
        """M6: the model and a JSON table beside it."""
        self.model.write().overwrite().save(f"{path}/model")
        side = json.dumps({"scaler": self.scaler, "threshold": self.threshold, "columns": self.columns})
        SparkSession.active().createDataFrame([(side,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side")

    @staticmethod
    def load(spark, path: str) -> PairModel:
        side = json.loads(spark.read.text(f"{path}/side").first()[0])
        return PairModel(PipelineModel.load(f"{path}/model"), {k: tuple(v) for k, v in side["scaler"].items()}, side["threshold"], side["columns"])


def train_classifier(train: DataFrame, validation: DataFrame, columns: list[str] = FEATURES, kind: str = "logistic") -> PairModel:
    """M2 (kind 'logistic') and M9 ('trees'): class-weighted, scaler from train, threshold (A28) from validation."""
    scaler = scaler_of(feature_scaler(train, columns))
    balance = class_balance(train).first()
    weighted = transform_features(train, scaler, columns).withColumn("_w", F.when(F.col("label") == 1, F.lit(float(balance["pos_weight"]))).otherwise(1.0))
    if "weight" in train.columns:
        weighted = weighted.withColumn("_w", F.col("_w") * F.col("weight"))
    learner = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", regParam=0.01, maxIter=50) if kind == "logistic" else GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=10, maxDepth=3, seed=7)
    model = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), learner]).fit(cut(weighted))
    out = PairModel(model, scaler, 0.5, columns)
    best = best_threshold(out.score(validation)).first()
    out.threshold = float(best["threshold"])
    return out


def evaluate(model: PairModel, splits: dict[str, DataFrame]) -> DataFrame:
    """M4: metrics, AUC, average precision and the warning for every split."""
    out = None
    for name, df in splits.items():
        scored = cut(model.score(df).select("label", "p"))
        row = binary_metrics(scored, threshold=model.threshold).join(roc_auc(scored), F.lit(True)).join(average_precision(scored), F.lit(True))  # one row each
        row = row.select(F.lit(name).alias("split"), "*", F.lit(WARNING).alias("note"))
        out = row if out is None else out.unionByName(row)
    return out


def platt_fit(df: DataFrame, score: str = "p", label: str = "label", steps: int = 30) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of a label by a score (Platt's smoothed targets), by Newton steps that are halved while the loss rises.

    A step is one aggregate of six sums, so any number of rows is fitted whole. Rows without
    a score or label are passed over; without rows the curve is 0.5 everywhere, and a score
    of one value fits the intercept alone.
    """
    rows = cut(df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).where("s is not null and y in (0, 1)"))
    n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("pos"), F.count("y").alias("all")).first()
    pos, neg = n["pos"], n["all"] - n["pos"]
    target = F.when(F.col("y") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    at, step, last = (0.0, math.log((pos + 1) / (neg + 1))), (0.0, 0.0), math.inf
    for _ in range(steps if n["all"] else 0):
        z = F.col("s") * at[0] + at[1]
        p = 1 / (1 + F.exp(-z))
        g, w = target - p, p * (1 - p)
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z
        x = rows.agg(F.sum(loss).alias("loss"), F.sum(g * F.col("s")).alias("ga"), F.sum(g).alias("gb"), F.sum(w * F.col("s") ** 2).alias("aa"), F.sum(w * F.col("s")).alias("ab"), F.sum(w).alias("bb")).first()
        if x["loss"] > last + 1e-12 * abs(last):
            step = (step[0] / 2, step[1] / 2)
            at = (at[0] - step[0], at[1] - step[1])
            continue
        last, det = x["loss"], x["aa"] * x["bb"] - x["ab"] ** 2
        if det > 1e-12 * x["aa"] * x["bb"]:
            step = ((x["bb"] * x["ga"] - x["ab"] * x["gb"]) / det, (x["aa"] * x["gb"] - x["ab"] * x["ga"]) / det)
        else:
            step = (0.0, x["gb"] / x["bb"])
        if max(map(abs, step)) < 1e-12:
            break
        at = (at[0] + step[0], at[1] + step[1])
    return at


def platt_calibrate(df: DataFrame, validation: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """M7: df with `calibrated`, by the curve fitted on the validation split, whose rows should not be df's."""
    a, b = platt_fit(validation, score, label)
    return df.withColumn("calibrated", 1 / (1 + F.exp(-(F.col(score) * a + b))))


def platt_cross_calibrate(df: DataFrame, key: str, score: str = "p", label: str = "label", seed: int = 7) -> DataFrame:
    """M7 where no split is set aside: keys are drawn into two halves, and each is calibrated by the curve of the other."""
    first = uniform(seed, F.col(key)) < 0.5
    return platt_calibrate(df.where(first), df.where(~first), score, label).unionByName(platt_calibrate(df.where(~first), df.where(first), score, label))
