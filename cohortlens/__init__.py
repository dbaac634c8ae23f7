"""Cohort-wide verification of scientific pipeline runs on Spark DataFrames."""
