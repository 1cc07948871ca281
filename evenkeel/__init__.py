"""evenkeel: class-imbalanced tabular data on Spark.

Load and encode mixed tables, plan class targets, resample or generate rows,
compare real with synthetic data and measure what resampling does to a
classifier. Everything is a DataFrame in, DataFrame out.
"""

from evenkeel.spec import FeatureSpec

__all__ = ["FeatureSpec"]
