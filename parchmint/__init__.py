"""Document analytics on Spark: documents as rows, their blocks, tables and checks as DataFrames."""
