"""recurq: recurring questions from chat conversations, on Spark DataFrames."""
