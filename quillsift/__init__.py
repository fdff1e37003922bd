"""Search and analysis of large catalogues of files, documents and events on Spark DataFrames."""
