"""Long-context question-answering data preparation, compression and scoring on Spark DataFrames."""
