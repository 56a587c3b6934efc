"""Training-data operators: dedup, mixing, packing, classification, search and formats.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; intermediate tables that cut lineage are written below the folder
named by ``spark.checkpoint.dir`` (see :mod:`tidemark.llm.common`).
"""
