"""quillspark: finance-ledger analytics and document processing on PySpark.

Everything is a function from DataFrames to DataFrames; Catalyst plans the
execution.  Sub-packages: ``sources`` (scans and sinks), ``functions`` (column
expressions), ``operators`` (relational operators), ``streaming`` (structured
streaming projections), ``plans`` (the registered queries) and the optional
``llm`` (training-data operators, which nothing else here imports).
"""
