"""rillflow: hydrologic and tabular analytics operators built on PySpark DataFrames."""

__version__ = "0.1.0"
