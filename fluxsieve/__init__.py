"""fluxsieve: curate, score and report on large flux-point scans with Spark DataFrames.

Every public operator is a plain function ``DataFrame -> DataFrame`` (or a
``Column`` builder) composed from native Spark expressions, joins, windows and
aggregates.  Python runs inside tasks only where a matrix product or a
per-group algorithm needs it (``mapInPandas`` / ``applyInPandas``).
"""

__version__ = "0.1.0"
