"""Finding, masking and auditing sensitive text with Spark DataFrames."""
