"""factloom: analytics over elementary facts, expressed as Spark DataFrames."""
