"""Text analytics on Spark DataFrames.

``functions`` build Column expressions (no shuffle), ``operators`` take and
return DataFrames, ``sources`` read and write files, ``streaming`` runs the same
operators on arriving files, and ``plans`` chain operators into whole jobs.
"""
