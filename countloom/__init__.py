"""Count-query workloads, table rewriting and table comparison on Spark DataFrames."""
