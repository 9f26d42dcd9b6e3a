"""weft: session analytics and text pipelines expressed as Spark DataFrames."""
