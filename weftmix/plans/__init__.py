"""Registered queries over the driver's tables and their DuckDB oracle SQL.

``inputs`` maps the driver tables onto the reference's record shapes;
``training``, ``evaluation``, ``conversations`` and ``runs`` build the
queries; ``oracle_*`` and ``sqlparts`` hold the SQL; ``catalog`` registers
both for ``__spark_entry__``.
"""
