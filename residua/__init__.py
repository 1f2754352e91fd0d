"""Sequence and preference-data toolkit on Spark.

Every public operator is a plain ``DataFrame -> DataFrame`` (or
``Column -> Column``) function over the public PySpark API, meant to be
chained with ``df.transform``.  There is no engine object and no plan of
our own: Catalyst plans every job.
"""

from residua.session import get_session, scratch_path

__all__ = ["get_session", "scratch_path"]
