"""Claim-based entity fusion and corpus operators on Spark DataFrames."""
