"""Training-data operators: text, media and near-duplicate jobs over Spark DataFrames.

Nothing outside this subpackage imports it.  Each operator has its own module;
``catalog`` binds them to the driver tables as queries.
"""
