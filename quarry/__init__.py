"""quarry: report, page and text profiling as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions, aggregates, windows and joins. Python runs inside tasks only
where no native expression exists (HTML tokenising, charset trial decoding,
stateful page-change tracking).
"""

from quarry.session import get_session, checkpoint_dir, load_table

__all__ = ["get_session", "checkpoint_dir", "load_table"]
