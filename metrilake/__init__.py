"""metrilake – metric time series analytics as Spark DataFrame operators."""
from .frame import Grid, MetricFrame, duration_ms, epoch_ms  # noqa: F401
from .session import build_session, ensure_conf, shared_dir  # noqa: F401
