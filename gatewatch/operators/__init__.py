"""DataFrame -> DataFrame operators of the audit and flight modules."""

from . import cleaning, filters, metrics, ordering, tables

__all__ = ["cleaning", "filters", "metrics", "ordering", "tables"]
