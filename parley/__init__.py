"""parley: meeting-transcript and speaker-identity analytics on PySpark.

Every operator takes DataFrames and returns a DataFrame (or takes Columns and
returns a Column), stays lazy, and is keyed by ``meeting`` plus a position.
"""
