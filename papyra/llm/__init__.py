"""Training-data pipeline operators: one module per operator, plus their registered queries and SQL.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when it is present.
"""
