"""Analytics over large document corpora as PySpark DataFrames."""
