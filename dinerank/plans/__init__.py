"""Composed plans: end-to-end jobs, the query catalogue and its SQL oracle."""
