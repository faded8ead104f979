"""Flat public API: every operator as a function taking a MetricFrame first.

``MetricFrame.<name>(...)`` forwards here, so ``mf.rate("5m", grid)`` and
``rate(mf, "5m", grid)`` are the same call.
"""
from .frame import Grid, MetricFrame  # noqa: F401
from .operators.select import from_table, from_map, select, bind, instant, time_bounds  # noqa: F401
from .operators.range_fns import (rate, irate, increase, deriv, predict_linear, changes,  # noqa: F401
                                  over_time, avg_over_time, min_over_time, max_over_time,
                                  last_over_time, subquery, subquery_grid, monotonic)
from .operators.agg import (aggregate, histogram_avg, sum_, avg, min_, max_, count, stdvar, count_values,  # noqa: F401
                            topk, histogram_quantile, absent, le_value)
from .operators.arith import (Scalar, scalar_op, where_value, compare_bool, neg, clamp_min, ceil,  # noqa: F401
                              label_replace, time_, vector, scalar, eval_time)
from .operators.match import (binop, set_and, set_unless, set_or, default_zero, coalesce_metrics,  # noqa: F401
                              info_join, assert_unique)
from .operators.intervals import annotate, choose_bucket_ms  # noqa: F401
