"""corpusloom: web-corpus operators on PySpark DataFrames."""
