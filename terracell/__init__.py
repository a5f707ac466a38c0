"""terracell: raster suitability analytics and record clean-up on Spark DataFrames."""
