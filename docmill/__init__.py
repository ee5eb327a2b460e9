"""docmill: corpus ingestion, chunking, retrieval, rule tagging and page
structure extraction expressed as Spark DataFrame / SQL plans.

Every public operator takes DataFrames and returns a DataFrame. Most trigger no
action, so callers compose them into one Catalyst plan. Retrieval fetches bounded
query blocks first, broadcast checks sum the rows they would send, and operators
that need a table twice write it under ``spark.checkpoint.dir``.
"""

from docmill.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
