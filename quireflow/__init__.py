"""Analytics over digitised tabular documents, on Spark DataFrames."""
