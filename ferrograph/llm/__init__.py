"""Training-data operators: dedup, decontamination, tokenising, scoring, archives.

Nothing outside this subpackage imports it.
"""
