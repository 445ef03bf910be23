"""leafmill: document analytics declared as Spark DataFrames."""
