"""Spark jobs that turn many overlapping feeds of postings into a ranked, explainable shortlist."""
