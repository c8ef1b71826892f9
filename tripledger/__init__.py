"""tripledger: trip-expense roll-up and cost forecasting on PySpark DataFrames."""
