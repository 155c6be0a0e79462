"""tarn: the operating picture of a medallion data lake, as Spark DataFrames.

Every operator takes DataFrames and returns a DataFrame.  Nothing here collects
a table, ranks a whole group in one task, or runs a Python function per row.
"""
