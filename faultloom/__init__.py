"""faultloom: pipeline-failure analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  Nothing here starts a job on its own
unless its docstring says so; Catalyst sees one lazy plan from scan to result.
"""
