"""zipfloom: a PySpark-native engine for frequency-controlled minimal-pair data.

Sub-packages
------------
``operators``  relational and iterative operators over DataFrames
``functions``  scalar column functions
``sources``    readers and writers
``plans``      named queries with their SQL counterparts
``streaming``  incrementally maintained reports
``llm``        training-data operators (optional, nothing else imports it)
"""

__version__ = "0.1.0"
