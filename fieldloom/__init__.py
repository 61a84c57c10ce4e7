"""Field analytics and tabular series operators on Spark DataFrames."""
