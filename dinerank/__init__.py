"""dinerank — preference-driven recommendation over listing tables, on Spark.

Everything is a DataFrame -> DataFrame transformation built from
``pyspark.sql.functions``; a table of preference requests is answered
against a table of listings in one distributed job.
"""

from dinerank.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"
