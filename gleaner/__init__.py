"""gleaner: a PySpark-native engine for collections of semi-structured text records."""

__version__ = "0.1.0"
