"""Allele-frequency statistics and admixture models on Spark DataFrames."""
