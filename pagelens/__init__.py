"""PageLens: web-page audit analytics and corpus operators on Spark DataFrames."""
