"""Applicant-level features from the history tables."""
