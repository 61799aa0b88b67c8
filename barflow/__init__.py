"""Tick-to-signal analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` that only extends the
logical plan; nothing here triggers a job, so whole studies compose into one plan.
"""
