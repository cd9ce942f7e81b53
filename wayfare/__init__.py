"""Random-walk probability queries over weighted, directed, dynamic graphs, as Spark DataFrames."""
