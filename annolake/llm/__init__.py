"""Operators for preparing training text: sharding, personal data, near copies, tokens, toxicity,
benchmark leaks, media columns, repeated lines, licence notices, token files, clusters of vectors and
tries of conversations.

Every operator takes and returns DataFrames, picks the columns it needs by name, so extra columns
never clash, and writes what must outlive a stage to the folder named in ``spark.checkpoint.dir``.
"""
