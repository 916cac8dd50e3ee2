"""Operators for preparing training text at scale.

Each module holds one operator as functions from DataFrames to DataFrames; :mod:`.registry` holds
the queries that apply them to whole tables, :mod:`.oracles` the SQL for those that SQL can express.
Nothing outside this folder imports it.
"""
