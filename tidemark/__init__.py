"""tidemark: search-quality analytics on PySpark.

Every operator takes and returns DataFrames; nothing runs until the caller
acts on the result, except where a docstring says that a step is written to
the shared checkpoint folder.
"""

__version__ = "0.1.0"
