"""Registered queries and the SQL that checks them."""


def load():
    """The registry with every query registered."""
    from . import registry, tables  # noqa: F401
    from . import cleaning_queries, index_queries, signal_queries, read_queries  # noqa: F401  (each uses the tables before it)

    return registry
