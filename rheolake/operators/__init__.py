"""Operators from DataFrame to DataFrame.  ``case_id`` is the first key everywhere, so many cases run as one job."""
