"""Contract-driven data products as PySpark jobs."""

from deedwork.session import Tables, build_session, scratch_root

__all__ = ["Tables", "build_session", "scratch_root"]
