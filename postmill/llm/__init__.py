"""Training-data operators: Spark jobs over document, page, label and conversation tables.

Nothing else in the library imports this package. Every operator takes DataFrames with
column names as parameters and returns a DataFrame; ``queries`` binds them to the tables.
"""
