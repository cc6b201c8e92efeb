"""quillspark: document and tabular analytics on PySpark DataFrames."""
