from tidemark.functions.dates import (as_timestamp, lead_days, month_label, month_start,
                                     parse_day_first)
from tidemark.functions.numeric import (money, money_sql, no_neg_zero, pct, ratio, rnd, rnd_sql,
                                       total, total_sql)

__all__ = ["as_timestamp", "lead_days", "month_label", "month_start", "parse_day_first",
           "money", "money_sql", "no_neg_zero", "pct", "ratio", "rnd", "rnd_sql",
           "total", "total_sql"]
