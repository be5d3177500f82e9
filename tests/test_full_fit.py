"""The oracle-checked forecast queries fit with the production parameters."""

import pytest

from tidemark.plans import catalog


class Fitted(Exception):
    pass


@pytest.mark.parametrize("query", [catalog.q_forecast_backtest_actuals, catalog.q_forecast_steps, catalog.q_forecast_cv_folds])
def test_forecast_queries_fit_whole_models(monkeypatch, query):
    def fit(frame, cfg, **_):
        raise Fitted(cfg)

    monkeypatch.setattr(catalog, "_model_frames", lambda spark, sf_dir: (None, None, None))
    for name in ("backtest", "rolling_origin_cv"):
        monkeypatch.setattr(catalog._fc, name, fit)
    with pytest.raises(Fitted) as got:
        query(None, None)
    assert got.value.args[0] == catalog.CFG
