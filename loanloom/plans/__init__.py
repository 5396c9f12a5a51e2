"""End-to-end jobs and the query catalogue built from the operators."""
