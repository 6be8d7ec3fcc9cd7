"""Feature stages: fitted on the training rows, saved, applied to raw bookings."""

import pytest
from pyspark.sql import functions as F

from conftest import SF

from bookrisk.operators import features as FE
from bookrisk.operators import pipeline as PL
from bookrisk.operators import train as TR
from bookrisk.plans import common as C


@pytest.mark.parametrize("which", PL.SETS)
def test_saved_pipeline_scores_raw_bookings_alone(spark, tmp_path, which):
    raw = C.bk(spark, SF)
    train = FE.add_target(raw).where("Branch <> 'B1' and Booking_ID % 2 = 0")
    model = PL.fit(train, which, "lr")
    features = model.stages[0]
    assert features.getOrDefault("prior") == train.agg(F.avg("No_Show")).first()[0]  # of the training rows alone
    assert features.fitted_levels() == FE.fit_levels(train, list(PL.ENCODED))
    TR.save(model, str(tmp_path / "m"))
    loaded = TR.load(str(tmp_path / "m"))
    assert isinstance(loaded.stages[0], PL.FeatureModel) and loaded.stages[0].names() == features.names()
    odd = raw.limit(50).withColumns({"Branch": F.lit("unseen"), "Service_Type": F.lit(None).cast("string")})
    for rows in (raw, odd):
        a, b = ({r["Booking_ID"]: r["no_show_probability"] for r in TR.score(m, rows, places=None).collect()} for m in (model, loaded))
        assert a == b and len(a) == rows.count() and all(0 <= p <= 1 for p in a.values())


def test_features_equal_the_library_functions(spark):
    raw = C.bk(spark, SF)
    model = PL.FeatureEstimator(featureSet="full").fit(FE.add_target(raw))
    got = model.transform(raw)
    want = FE.one_hot(FE.build_full(raw, model.getOrDefault("prior")), model.fitted_levels())
    names = model.names()
    assert set(names) >= {"Smoothed_NoShow_Rate", "NoShow_x_LeadTime"} and got.columns == ["Booking_ID", *names]
    cast = [F.col(f"`{c}`").cast("double").alias(c) for c in names]
    assert got.exceptAll(want.select("Booking_ID", *cast)).count() == 0
    with pytest.raises(ValueError, match="unknown feature set"):
        PL.FeatureEstimator(featureSet="other")
