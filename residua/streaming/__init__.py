"""Structured Streaming helpers.

The reference has no unbounded input; its scalar functions are
stateless Column expressions and run unchanged on streaming
DataFrames.  Group-relative advantages need complete groups, so they are
computed per micro-batch in ``foreachBatch``.
"""
