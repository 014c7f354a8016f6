"""Operators on DataFrames: homology, regions, gene models, cleavage, regulation, features, models."""
