"""Cohort features, curation of imbalanced data and evaluation of scored partitions, on Spark DataFrames."""
