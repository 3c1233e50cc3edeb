"""Tessera: a chainable, immutable query layer over Spark DataFrames."""
