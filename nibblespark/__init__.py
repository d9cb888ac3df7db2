"""Analytics over arrays of narrow unsigned integers, expressed as Spark DataFrames."""
