"""A strict, strongly typed SQL dialect and relational operators on Spark DataFrames."""
