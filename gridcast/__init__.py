"""gridcast: forecasting-panel analytics as Spark DataFrame jobs.

Layout
------
sources/    landed-feed readers and the stand-in shapes built from the test tables
functions/  scalar column expressions (coercion, price chain, calendar, normal tail)
operators/  DataFrame -> DataFrame operators (time series, scopes, ladder, gates, ledger,
            metrics, splits, correlation)
plans/      registered queries and their DuckDB oracle SQL
learn/      Spark ML model fitting and selection
sinks/      CSV / JSON / Parquet writers
streaming/  Structured Streaming variants
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
