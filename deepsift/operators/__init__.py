"""Operators over reads, pileup columns and variants; every one takes and returns DataFrames."""
