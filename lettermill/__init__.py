"""Analytics over archives of scanned, transcribed and translated letters, on Spark."""

__version__ = "0.1.0"
