"""Document-layout analytics on PySpark: DataFrame in, DataFrame out."""
