"""Operators on DataFrames: pairing, behaviour, windows, sampling, selection, resampling, estimators, audits."""
