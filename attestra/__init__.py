"""Evidence-aware document analytics on Spark DataFrames."""
