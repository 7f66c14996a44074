"""Learner analytics and content quality operators for Spark DataFrames."""
