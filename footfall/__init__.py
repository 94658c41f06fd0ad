"""Urban mobility analytics on PySpark DataFrames."""
