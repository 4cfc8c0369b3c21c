"""Analytics over evidence-weighted causal graphs, on Spark DataFrames."""
