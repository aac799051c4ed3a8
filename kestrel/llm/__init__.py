"""Training-data operators: one module per operator, all over plain DataFrames.

Nothing outside this package imports it; ``__spark_entry__`` registers
:mod:`kestrel.llm.catalog` when the package is present.
"""
