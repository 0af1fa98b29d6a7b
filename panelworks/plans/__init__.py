"""Compositions of operators: the feature table and the model plans."""
