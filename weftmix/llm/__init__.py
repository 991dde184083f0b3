"""Training-data operators over web-scale document tables.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when the subpackage is present.
"""
