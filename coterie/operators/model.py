"""Feature matrix, correlated-column pruning, boosting and calibration on pyspark.ml."""

from __future__ import annotations

import json
import re
from collections import Counter
from itertools import combinations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.numeric import logit
from coterie.functions.quantile import ranged
from coterie.operators.split import first_by_time, valid_split
from coterie.sources.adapters import ID, LABEL, TIME

DROPPED = (ID, LABEL, TIME, "client_id", "ring_id", "_card_anchor", "_ring_truth", "_day", "ring_first_seen")
RING_PREFIXES = ("ring_", "client_", "entity_")


def feature_names(df: DataFrame) -> list[str]:
    """Columns that may be features: no identifiers, target, time, or ring labels."""
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("column names repeat")
    return [c for c in df.columns if c not in DROPPED and not c.startswith("_ring")]


def to_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named features in order; those missing are null."""
    names = names or feature_names(df)
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in names])


def without_ring_features(names: list[str]) -> list[str]:
    return [n for n in names if not n.startswith(RING_PREFIXES)]


def pair_correlation(a: str, b: str):
    """Pearson over rows where both are known; null, not an error, where one of them is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column_name, nulls, n_distinct`` of each column, from one pass."""
    per = [F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("n_distinct")) for c in cols]
    return df.agg(F.array(*per).alias("x")).select(F.explode("x").alias("x")).select("x.*")


class VBlockReducer:
    """Drops columns that correlate with one already kept, within blocks of equal null counts.

    Columns are V followed by digits.  In a block they are taken by distinct count, most first (ties
    by column order), and kept while all absolute correlations with kept ones are below the limit; a
    correlation that is null (a constant column) counts as too high.  ``sample_rows``: the first rows by
    time that are looked at, all if None.
    """

    def __init__(self, corr_threshold: float = 0.75, sample_rows: int | None = 100_000):
        self.corr_threshold, self.sample_rows = corr_threshold, sample_rows
        self.kept: list[str] = []
        self.dropped: list[str] = []

    @staticmethod
    def columns(df: DataFrame) -> list[str]:
        return [c for c in df.columns if re.fullmatch(r"V\d+", c)]

    def fit(self, df: DataFrame) -> "VBlockReducer":
        cols = self.columns(df)
        self.kept, self.dropped = [], []
        if not cols:
            return self
        sample = df.select(*cols) if self.sample_rows is None else first_by_time(df.select(ID, TIME, *cols), self.sample_rows)
        profile = {r["column_name"]: r for r in column_profile(sample, cols).collect()}  # one row per column
        blocks: dict[int, list[str]] = {}
        for c in cols:
            blocks.setdefault(profile[c]["nulls"], []).append(c)
        wanted = [p for b in blocks.values() for p in combinations(b, 2)]
        corr: dict[frozenset, float | None] = {}
        for i in range(0, len(wanted), 200):  # columns of one aggregate row, not data
            part = wanted[i : i + 200]
            row = sample.agg(*[F.abs(pair_correlation(a, b)).alias(f"c{k}") for k, (a, b) in enumerate(part)]).collect()[0]
            corr |= {frozenset(p): row[f"c{k}"] for k, p in enumerate(part)}
        for b in blocks.values():
            keep: list[str] = []
            for c in sorted(b, key=lambda c: (-profile[c]["n_distinct"], cols.index(c))):
                values = [corr[frozenset((c, k))] for k in keep]
                if all(v is not None and v < self.corr_threshold for v in values):
                    keep.append(c)
            self.kept += keep
        self.kept.sort(key=lambda c: int(c[1:]))
        self.dropped = [c for c in cols if c not in self.kept]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)

    def save(self, spark, path: str) -> None:
        """The choice as one JSON line."""
        line = json.dumps({"corr_threshold": self.corr_threshold, "kept": self.kept, "dropped": self.dropped})
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> "VBlockReducer":
        got = json.loads(spark.read.text(path).first()["value"])
        out = cls(got["corr_threshold"])
        out.kept, out.dropped = got["kept"], got["dropped"]
        return out


class TrainedModel:
    """Boosted trees with a logistic calibration on the logit of their score; both are saved."""

    def __init__(self, trees: PipelineModel, names: list[str], platt=None):
        self.trees, self.names, self.platt = trees, names, platt

    def raw(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(df).withColumn("raw_score", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "features")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds raw_score and score."""
        out = self.raw(df)
        if self.platt is None:
            return out.withColumn("score", F.col("raw_score"))
        slope, base = float(self.platt.coefficients[0]), float(self.platt.intercept)
        return out.withColumn("score", 1 / (1 + F.exp(-(slope * logit("raw_score") + base))))

    def importance(self) -> list[tuple[str, float, int, bool]]:
        """(feature, share of gain, splits, is a ring feature), most first."""
        trees = self.trees.stages[-1]
        used = Counter(int(i) for i in re.findall(r"If \(feature (\d+) ", trees.toDebugString))
        gains = trees.featureImportances.toArray()
        rows = ((n, float(g), used[i], n.startswith(RING_PREFIXES)) for i, (n, g) in enumerate(zip(self.names, gains)))
        return sorted(rows, key=lambda x: -x[1])

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(path + "/trees")
        if self.platt is not None:
            self.platt.write().overwrite().save(path + "/platt")

    @classmethod
    def load(cls, path: str, names: list[str], calibrated: bool = True) -> "TrainedModel":
        from pyspark.ml.classification import LogisticRegressionModel

        return cls(PipelineModel.load(path + "/trees"), names, LogisticRegressionModel.load(path + "/platt") if calibrated else None)


def fit_platt(scored: DataFrame):
    """Logistic regression on the clipped logit; refuses a score that ranks the wrong way round."""
    n = scored.count()
    rows = VectorAssembler(inputCols=["_z"], outputCol="_v").transform(scored.withColumn("_z", logit("raw_score"))).withColumn("_y", F.col(LABEL).cast("double"))
    model = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1 / (1e6 * max(n, 1)), standardization=False, maxIter=200, tol=1e-9).fit(rows)
    if model.coefficients[0] <= 0:
        raise ValueError("the score ranks frauds below others")
    return model


def rank_mismatches(df: DataFrame) -> DataFrame:
    """One row: neighbours in raw order whose calibrated scores are in the opposite order.

    Distinct raw scores, with their least and greatest calibrated score, are dealt by range; neighbours in
    different ranges are compared over one row per range.
    """
    per = ranged(df.groupBy("raw_score").agg(F.min("score").alias("lo"), F.max("score").alias("hi")), F.asc("raw_score"))
    before = F.lag("hi").over(Window.partitionBy("_range").orderBy("raw_score"))
    inside = per.withColumn("bad", (before > F.col("lo")).cast("int")).groupBy("_range").agg(
        F.sum("bad").alias("bad"), F.min_by("lo", "raw_score").alias("first"), F.max_by("hi", "raw_score").alias("last")
    )
    edge = (F.lag("last").over(Window.orderBy("_range")) > F.col("first")).cast("int")  # one row per range
    both = inside.withColumn("edge", edge).agg(F.coalesce(F.sum("bad"), F.lit(0)) + F.coalesce(F.sum("edge"), F.lit(0)))
    return both.toDF("mismatches")


def train(df: DataFrame, names: list[str], calibrate: bool = True, max_iter: int = 40, step: float = 0.1, max_bins: int = 63,
          subsample: float = 0.8, seed: int = 42, valid_fraction: float = 0.2) -> TrainedModel:
    """Boosting with early stopping on the last part of training time, then calibration on that part.

    Text features are categories.  One with more levels than bins is a number instead, the rank of its
    level by frequency, which trees cut into bins; levels not seen in training come last.
    """
    if len(set(names)) != len(names):
        raise ValueError("feature names repeat")
    kinds = dict(df.dtypes)
    text = [n for n in names if kinds[n] == "string"]
    numeric = [n for n in names if n not in text]
    rows = valid_split(df.where(F.col(LABEL).isNotNull()), valid_fraction)
    base = rows.withColumn("_y", F.col(LABEL).cast("double"))
    cast = _Cast(numeric)
    stages = [cast] if numeric else []
    wide: list[str] = []
    if text:
        levels = base.agg(*[F.count_distinct(n).alias(f"n{i}") for i, n in enumerate(text)]).collect()[0]  # one row
        wide = [n for i, n in enumerate(text) if levels[f"n{i}"] >= max_bins - 1]
        stages.append(StringIndexer(inputCols=text, outputCols=[f"_s_{n}" if n in wide else f"_i_{n}" for n in text], handleInvalid="keep"))
    if wide:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(f"`_s_{n}` + 0D AS `_i_{n}`" for n in wide) + " FROM __THIS__"))
    if numeric:
        stages.append(Imputer(inputCols=[f"_x_{n}" for n in numeric], outputCols=[f"_f_{n}" for n in numeric]))
    columns = [f"_i_{n}" if n in text else f"_f_{n}" for n in names]
    stages.append(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(labelCol="_y", featuresCol="features", maxIter=max_iter, stepSize=step, maxBins=max_bins, subsamplingRate=subsample,
                                validationIndicatorCol="is_valid", seed=seed, maxDepth=5))
    model = TrainedModel(Pipeline(stages=stages).fit(base), names)
    if calibrate:
        model.platt = fit_platt(model.raw(base.where("is_valid")))
    return model


def _Cast(numeric: list[str]):
    picks = ", ".join(f"CAST(`{n}` AS DOUBLE) AS `_x_{n}`" for n in numeric)
    return SQLTransformer(statement=f"SELECT *, {picks} FROM __THIS__")
