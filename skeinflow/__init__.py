"""Text-corpus dataflow engine on PySpark DataFrames."""
