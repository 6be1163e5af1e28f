"""Splitting, feature preparation, training, evaluation and scoring."""
