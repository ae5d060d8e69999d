"""Visibility analytics on Spark: isovists, visible volumes, rasters, graphs and camera walks as DataFrame plans."""
