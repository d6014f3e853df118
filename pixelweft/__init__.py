"""Raster analytics on PySpark: images are tables of pixels, operators are plans over them."""
