"""Analytics over collections of drug-label documents, expressed as Spark DataFrames."""
