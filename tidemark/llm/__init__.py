"""Training-data operators: search, filtering, near duplicates, packing, archives and tokenizers.

Each module is one operator with a general interface on DataFrames; ``queries`` registers the thin
``opN_<name>`` queries over the test tables. Nothing outside this package imports it.
"""
