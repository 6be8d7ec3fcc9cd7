"""Features as fitted stages of a saved pipeline.

``FeatureEstimator`` learns what features need of the training rows (the
smoothing prior and the levels of the categorical columns) and gives a
``FeatureModel`` that turns raw bookings into the columns of one of three
feature sets. Both are ML stages with saved parameters, so a saved pipeline
holds everything: loaded, it scores raw bookings alone.

Unknown or null levels encode as zeros; a training table without a label rate
has the prior 0; rows keep their key, label, weight and split if they have
them.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookrisk.operators import features as FE
from bookrisk.operators import train as TR
from bookrisk.sources import schema as S

SETS = ("base", "full", "pruned")
KEPT = ("Booking_ID", "No_Show", "weight", "split")
ENCODED = ("Service_Type", "Branch", "Payment_Method", "Day_of_Week")


def feature_names(which: str, levels: dict[str, list[str]]) -> list[str]:
    """The columns of a feature set."""
    if which == "pruned":
        return list(S.PRUNED)
    extra = S.EXTRA_ENGINEERED if which == "full" else []
    return ["Customer_Latent_Risk", *S.ENGINEERED, *extra, *FE.one_hot_names(levels)]


class _Set(Params):
    featureSet = Param(Params._dummy(), "featureSet", "base, full or pruned", typeConverter=TypeConverters.toString)

    def which(self) -> str:
        return self.getOrDefault(self.featureSet)


class FeatureModel(Model, _Set, DefaultParamsReadable, DefaultParamsWritable):
    prior = Param(Params._dummy(), "prior", "no-show rate of the training rows", typeConverter=TypeConverters.toFloat)
    levels = Param(Params._dummy(), "levels", "levels of the categorical columns, JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featureSet: str = "base", prior: float = 0.0, levels: str = "{}"):
        super().__init__()
        self._set(featureSet=featureSet, prior=prior, levels=levels)

    def fitted_levels(self) -> dict[str, list[str]]:
        return json.loads(self.getOrDefault(self.levels))

    def names(self) -> list[str]:
        return feature_names(self.which(), self.fitted_levels())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        levels = self.fitted_levels()
        built = FE.one_hot(FE.build_full(dataset, self.getOrDefault(self.prior), with_target=False), levels)
        rows = FE.align_columns(built, [c for c in KEPT if c in dataset.columns] + self.names())
        return rows.withColumns({c: F.col(f"`{c}`").cast("double") for c in self.names()})


class FeatureEstimator(Estimator, _Set, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, featureSet: str = "base"):
        super().__init__()
        if featureSet not in SETS:
            raise ValueError(f"unknown feature set {featureSet!r}")
        self._set(featureSet=featureSet)

    def _fit(self, dataset: DataFrame) -> FeatureModel:
        prior = dataset.agg(F.avg("No_Show")).first()[0] or 0.0
        levels = FE.fit_levels(dataset, list(ENCODED))
        return FeatureModel(featureSet=self.which(), prior=float(prior), levels=json.dumps(levels))


def fit(train: DataFrame, which: str, kind: str, settings: str = "script") -> PipelineModel:
    """Fit features and classifier on raw bookings with ``No_Show``."""
    rows, total = TR.weighted(TR.spread(train, train.count()), kind, settings)
    features = FeatureEstimator(featureSet=which).fit(rows)
    rest = Pipeline(stages=[VectorAssembler(inputCols=features.names(), outputCol="features", handleInvalid="keep"), *TR.estimator(kind, total, settings)])
    return PipelineModel([features, *rest.fit(features.transform(rows)).stages])
