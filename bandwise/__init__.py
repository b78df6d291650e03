"""Portfolio segmentation on Spark DataFrames.

``sources`` stacks tables, ``functions`` holds row expressions, ``operators``
the table operators (summaries, quantiles, outliers, Information Value, bands,
grids) and ``plans`` what combines them: scoring chains and report tables.
"""
