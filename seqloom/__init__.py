"""seqloom: the data side of sequential recommendation on PySpark DataFrames."""
