"""DuckDB SQL (oracle side) for the monthly-series chain: monthly frame ->
window features -> statistics -> seasonal-naive predictions -> metrics,
bands, flags and votes. Built as CTE text so each registered query can stop
at the step it checks.
"""

from __future__ import annotations

from tidemark.config import EMA_SPANS, LAGS, ROLL_MEANS, ROLL_STDS, PipelineConfig
from tidemark.functions.numeric import money_sql as M
from tidemark.functions.numeric import rnd_sql as R
from tidemark.functions.numeric import total_sql as T
from tidemark.sources.tables import sales_fact_sql

CFG = PipelineConfig()
_W = "PARTITION BY series_key ORDER BY period"


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def monthly_cte(key: str | None) -> str:
    roles = ["order_date", "sales"] + ([key] if key else [])
    k = f"CAST({key} AS VARCHAR)" if key else "'ALL'"
    where = f"WHERE {key} IS NOT NULL" if key else ""
    return f"""m AS (
  SELECT {k} AS series_key, CAST(date_trunc('month', order_date) AS DATE) AS period,
         {T('sales')} AS sales
  FROM {sales_fact_sql(roles)} f {where} GROUP BY 1, 2)"""


def features_ctes() -> str:
    cols = [f"lag(sales, {k}) OVER ({_W}) AS lag{k}" for k in LAGS]
    for k in ROLL_MEANS:
        fr = f"{_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING"
        cols.append(f"CASE WHEN count(sales) OVER ({fr}) = {k} THEN avg(sales) OVER ({fr}) END AS roll{k}_mean")
    for k in ROLL_STDS:
        fr = f"{_W} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING"
        cols.append(f"CASE WHEN count(sales) OVER ({fr}) = {k} THEN stddev_samp(sales) OVER ({fr}) END AS roll{k}_std")
    cols.append(f"list(sales) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist")
    emas = []
    for s in EMA_SPANS:
        a = 2.0 / (s + 1.0)
        emas.append(f"CASE WHEN len(hist) > 0 THEN list_reduce(hist, lambda acc, x: "
                    f"{_dbl(1.0 - a)} * acc + {_dbl(a)} * x) END AS ema{s}")
    required = ([f"lag{k}" for k in LAGS] + [f"roll{k}_mean" for k in ROLL_MEANS]
                + [f"roll{k}_std" for k in ROLL_STDS] + [f"ema{s}" for s in EMA_SPANS])
    return f"""fe0 AS (SELECT series_key, period, sales, {', '.join(cols)} FROM m),
fe1 AS (SELECT * EXCLUDE (hist), {', '.join(emas)},
        CAST(month(period) AS INTEGER) AS month, CAST(quarter(period) AS INTEGER) AS quarter,
        CAST(year(period) AS INTEGER) AS year, CAST(month(period) >= 10 AS INTEGER) AS is_q4,
        (sales - lag1) / NULLIF(lag1, 0) * 100.0 AS mom_pct,
        (sales - lag12) / NULLIF(lag12, 0) * 100.0 AS yoy_pct,
        sales - roll3_mean AS dev_roll3
        FROM fe0),
fe AS (SELECT * FROM fe1 WHERE {' AND '.join(c + ' IS NOT NULL' for c in required)})"""


def features_select() -> str:
    lags = ", ".join(f"{M(f'lag{k}')} AS lag{k}" for k in LAGS)
    return f"""SELECT series_key, strftime(period, '%Y-%m') AS period, {M('sales')} AS sales, {lags},
  {M('roll3_mean', 2, 4)} AS roll3_mean, {M('roll6_mean', 2, 5)} AS roll6_mean,
  {M('roll12_mean', 2, 6)} AS roll12_mean, {R('roll3_std', 2)} AS roll3_std,
  {R('roll6_std', 2)} AS roll6_std, {R('ema3', 2)} AS ema3, {R('ema6', 2)} AS ema6,
  {R('ema12', 2)} AS ema12, month, quarter, year, is_q4, {R('mom_pct', 2)} AS mom_pct,
  {R('yoy_pct', 2)} AS yoy_pct, {M('dev_roll3', 2, 4)} AS dev_roll3
FROM fe"""


def stats_cte() -> str:
    p = "PARTITION BY series_key"
    return f"""st0 AS (SELECT *, quantile_cont(sales, 0.25) OVER ({p}) AS q1,
                quantile_cont(sales, 0.75) OVER ({p}) AS q3,
                (sales - avg(sales) OVER ({p})) / NULLIF(stddev_samp(sales) OVER ({p}), 0) AS z_score
         FROM fe),
st1 AS (SELECT *, q1 - {_dbl(CFG.iqr_k)} * (q3 - q1) AS iqr_lo, q3 + {_dbl(CFG.iqr_k)} * (q3 - q1) AS iqr_hi FROM st0),
st AS (SELECT *, (sales < iqr_lo OR sales > iqr_hi OR COALESCE(abs(z_score) > {_dbl(CFG.z_limit)}, FALSE)) AS stat_flag,
              CASE WHEN sales > iqr_hi THEN 'spike' WHEN sales < iqr_lo THEN 'drop' ELSE 'pattern' END AS direction
       FROM st1)"""


def naive_ctes() -> str:
    h, extra = CFG.holdout, CFG.short_extra
    return f"""sp AS (SELECT *, count(*) OVER (PARTITION BY series_key) AS n_rows,
              row_number() OVER (PARTITION BY series_key ORDER BY period DESC) AS rd FROM fe),
pr AS (SELECT series_key, period, sales AS actual, lag12 AS predicted,
              rd <= CASE WHEN n_rows <= {h + extra} THEN GREATEST(2, n_rows // 4) ELSE {h} END AS is_test
       FROM sp),
pn AS (SELECT *, arg_max(CASE WHEN NOT is_test THEN actual END, CASE WHEN NOT is_test THEN period END)
                   OVER (PARTITION BY series_key) AS naive FROM pr),
mt0 AS (SELECT series_key, COUNT(*) AS n_test,
               AVG(abs((actual - predicted) / NULLIF(actual, 0))) * 100.0 AS mape_raw,
               sqrt(AVG((actual - predicted) * (actual - predicted))) AS rmse_raw,
               SUM((actual - predicted) * (actual - predicted)) AS ss_res,
               var_pop(actual) * COUNT(*) AS ss_tot,
               AVG(abs(actual - predicted)) AS mae, AVG(abs(actual - naive)) AS mae_naive
        FROM pn WHERE is_test GROUP BY series_key),
mt AS (SELECT series_key, n_test, {R('mape_raw', 2)} AS mape, {R('rmse_raw', 2)} AS rmse,
              {R('CASE WHEN ss_tot > 0 THEN 1.0 - ss_res / ss_tot WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END', 4)} AS r2,
              {R('CASE WHEN mae_naive > 0 THEN mae / mae_naive ELSE 1.0 END', 4)} AS mase, rmse_raw
       FROM mt0)"""


def bands_ctes() -> str:
    return f"""lst AS (SELECT series_key, period, sales,
               row_number() OVER (PARTITION BY series_key ORDER BY period DESC) AS rd,
               max(period) OVER (PARTITION BY series_key) AS last_p FROM fe),
fc AS (SELECT series_key, CAST(13 - rd AS INTEGER) AS step,
              CAST(last_p + to_months(CAST(13 - rd AS INTEGER)) AS DATE) AS period, sales AS forecast_raw
       FROM lst WHERE rd <= 12),
bd AS (SELECT fc.series_key, strftime(fc.period, '%Y-%m') AS period, fc.step,
              {M(f'GREATEST(forecast_raw, {_dbl(CFG.forecast_floor)})')} AS forecast,
              {R(f'GREATEST(0.0, GREATEST(forecast_raw, {_dbl(CFG.forecast_floor)}) - {_dbl(CFG.z_band)} * mt.rmse_raw * sqrt(CAST(fc.step AS DOUBLE)))', 2)} AS lower_90,
              {R(f'GREATEST(forecast_raw, {_dbl(CFG.forecast_floor)}) + {_dbl(CFG.z_band)} * mt.rmse_raw * sqrt(CAST(fc.step AS DOUBLE))', 2)} AS upper_90
       FROM fc JOIN mt ON fc.series_key = mt.series_key)"""


def votes_ctes() -> str:
    return f"""rf AS (SELECT pr.series_key, pr.period,
              abs({M('actual')} - {M('predicted')}) > {_dbl(CFG.resid_k)} * mt.rmse AS resid_flag
       FROM pr JOIN mt ON pr.series_key = mt.series_key WHERE pr.is_test),
vt0 AS (SELECT st.*, COALESCE(rf.resid_flag, FALSE) AS resid_flag
        FROM st LEFT JOIN rf ON st.series_key = rf.series_key AND st.period = rf.period),
vt AS (SELECT *, CAST(CAST(stat_flag AS INTEGER) + CAST(resid_flag AS INTEGER) AS BIGINT) AS votes FROM vt0),
vs AS (SELECT *, votes >= 2 AS is_anomaly,
              CASE WHEN votes >= 3 THEN 'critical' WHEN votes = 2 THEN 'high' ELSE 'normal' END AS severity
       FROM vt)"""


def chain(key: str | None, *parts: str) -> str:
    ctes = [monthly_cte(key), features_ctes()]
    for p in parts:
        ctes.append({"stats": stats_cte, "naive": naive_ctes, "bands": bands_ctes,
                     "votes": votes_ctes}[p]())
    return "WITH " + ",\n".join(ctes)


def monthly_counts_cte(key: str | None) -> str:
    roles = ["order_date", "sales", "order_id", "product_id", "customer_id"] + ([key] if key else [])
    k = f"CAST({key} AS VARCHAR)" if key else "'ALL'"
    where = f"WHERE {key} IS NOT NULL" if key else ""
    return f"""SELECT {k} AS series_key, strftime(date_trunc('month', order_date), '%Y-%m') AS period,
       {M(T('sales'))} AS sales, COUNT(DISTINCT order_id) AS n_orders,
       COUNT(DISTINCT product_id) AS n_products, COUNT(DISTINCT customer_id) AS n_customers,
       {R('AVG(sales)', 2)} AS avg_txn_sale
FROM {sales_fact_sql(roles)} f {where} GROUP BY 1, 2"""


def gapfill_sql(key: str) -> str:
    return f"""WITH {monthly_cte(key)},
b AS (SELECT series_key, MIN(period) AS a, MAX(period) AS z FROM m GROUP BY 1),
sp AS (SELECT series_key, CAST(UNNEST(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS period FROM b)
SELECT sp.series_key, strftime(sp.period, '%Y-%m') AS period, {M('COALESCE(m.sales, 0.0)')} AS sales
FROM sp LEFT JOIN m ON sp.series_key = m.series_key AND sp.period = m.period"""
