"""sparkwright: DataFrame-in, DataFrame-out analytics and modelling operators on Spark."""

__version__ = "0.1.0"
