"""Training-data operators: near-dedup, filters, scoring, tokenizing and decontamination.

Each module holds one operator with its own general interface; ``queries`` holds the
thin ``opN_*`` queries over the shared tables.  Nothing else in the library imports
this subpackage.
"""
