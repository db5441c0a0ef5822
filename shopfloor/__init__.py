"""Job-status and work-in-process costing for manufacturing ERP tables, on Spark.

Every operator is a function from DataFrames to a DataFrame. The ERP tables are
passed as a mapping from table name to DataFrame (see ``shopfloor.sources``).
"""
