"""Training-data operators: language, quality, privacy, duplicates, packing and scoring.

Nothing outside this subpackage imports it.  ``registry`` lists its queries.
"""
