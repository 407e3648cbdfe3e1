"""Folioscope: provenance-first document analytics on Spark DataFrames."""
