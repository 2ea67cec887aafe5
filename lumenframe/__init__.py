"""lumenframe: calibrated raster, spectrum and scan analytics as Spark DataFrame plans."""
