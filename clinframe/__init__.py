"""Clinical-records analytics and training-data operators on PySpark."""
