"""lodeweave: knowledge-graph rule analytics and data-processing operators on PySpark DataFrames."""

__version__ = "0.1.0"
