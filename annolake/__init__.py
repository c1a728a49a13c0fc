"""annolake: versioned tables of 3-D point annotations as Spark DataFrames."""
