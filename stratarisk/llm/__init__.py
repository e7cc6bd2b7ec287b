"""Training-data operators: sharding, deduplication, filtering, packing.

Every operator is a function from DataFrames to DataFrames. Bulk text work
runs in Arrow batches with numpy inside tasks (or in plain Spark SQL for the
native operators); Spark does all partitioning, shuffling and joining.
"""
