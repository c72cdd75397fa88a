"""Labelled-text analytics on Spark: clean, profile, featurise, select models, score."""
