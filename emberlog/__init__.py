"""Log-anomaly analytics as Spark jobs: every operator takes and returns DataFrames."""

from emberlog.session import build_session, tune

__all__ = ["build_session", "tune"]
