"""gatewatch: exit-gate audit and flight-log analytics as Spark DataFrame
operators (cleaning, filters, KPIs, rankings, text rules, table upkeep)."""

__version__ = "0.1.0"
