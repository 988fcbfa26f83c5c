"""arcframe: web-archive and document analytics as PySpark DataFrames."""
