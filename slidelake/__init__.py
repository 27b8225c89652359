"""slidelake: whole-slide-image metadata, tile grids and corpus preparation as PySpark DataFrame operators."""

__version__ = "0.1.0"
