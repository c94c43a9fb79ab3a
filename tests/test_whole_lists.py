"""The learned queries ask for every grid and every model; the fits themselves are replaced, as they take long."""

from types import SimpleNamespace

import pytest

from tabulens.catalog import modelling
from tabulens.ml import models

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.fixture
def trained(spark, monkeypatch):
    t = SimpleNamespace(train=spark.range(100))
    monkeypatch.setattr(modelling, "_trained", lambda *_, **__: t)
    monkeypatch.setattr(models, "folded_for", lambda train, folds: train)
    return t


def test_tune_model_runs_every_grid(spark, monkeypatch, trained):
    monkeypatch.setattr(models, "tune", lambda estimator, grid, train, folded: (None, {}, [0.5] * len(grid)))
    pool = models.registry(100)
    want = {(name, i) for name, est in pool.items() for i in range(len(models.tuning_grid(name, est) or []))}
    assert len({name for name, _ in want}) == 5
    assert {(r.model, r.point) for r in modelling.tune_model(spark, SF).collect()} == want


def test_cross_validate_takes_every_model(spark, monkeypatch, trained):
    monkeypatch.setattr(models, "cross_validate", lambda estimator, df, folded: spark.range(1))
    assert sorted(r.model for r in modelling.cross_validate(spark, SF).collect()) == sorted(models.registry_names())


def test_scoring_trains_every_model_and_the_job_tunes(spark, monkeypatch):
    asked = {}

    def train(*_, **options):
        asked.update(options)
        raise Asked

    monkeypatch.setattr(models, "train_supervised", train)
    with pytest.raises(Asked):
        modelling.score_test(spark, SF)
    assert asked.get("models") is None
    asked.clear()
    with pytest.raises(Asked):
        modelling.anomaly_job_supervised(spark, SF)
    assert asked["tune_models"] is True and not asked.get("models")
