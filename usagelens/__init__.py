"""usagelens: storage-usage statistics on Spark DataFrames.

Every operator is a plain function ``(DataFrame..., as_of, parameters) -> DataFrame``.
"""

__version__ = "0.1.0"
