"""Operators of a training-data pipeline: labelling, deduplication, decontamination, search and packing.

Nothing else in the library imports this subpackage. ``queries.load_all()`` registers its queries.
"""
