"""Training-data operators (quality, near-duplicates, decontamination, mixing, ...).

Every operator is a function on DataFrames; ``queries.py`` registers one query
per operator over the whole test tables and ``oracle.py`` holds the DuckDB SQL
where SQL can express the result. Nothing outside this package imports it.
"""
