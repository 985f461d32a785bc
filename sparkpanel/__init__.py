"""sparkpanel: Spark-native operators for entity-by-period (panel) data.

Every public operator takes DataFrames (plus parameters) and returns a
DataFrame.  Actions happen only where a result is a bounded report (a fitted
constant per column, a threshold grid) or inside ``pyspark.ml`` fits.
"""

__version__ = "0.1.0"
