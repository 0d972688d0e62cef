"""nearword: spatial-keyword analytics on PySpark DataFrames."""
