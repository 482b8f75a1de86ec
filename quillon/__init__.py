"""quillon: interval, label and feature-code analytics on Spark DataFrames."""
