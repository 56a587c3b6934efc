"""Security and stream analytics as DataFrame operators.

- ``functions``: scalar Columns and closed forms,
- ``operators``: DataFrame -> DataFrame operators,
- ``sources``: readers, writers and file formats,
- ``streaming``: stateful and micro-batch operators,
- ``plans``: session, query registry and the query catalogue.
"""
