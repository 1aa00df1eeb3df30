"""Relational operators on questions, predictions and rollouts: DataFrames in, DataFrames out."""
