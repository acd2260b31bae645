"""Analytics over catalogues of research papers, as Spark DataFrames."""
