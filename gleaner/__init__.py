"""gleaner: message-risk analytics and corpus preparation, expressed as Spark DataFrames."""
