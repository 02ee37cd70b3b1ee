"""tessera: a small relational analytics engine declared on Spark DataFrames."""
