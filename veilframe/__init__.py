"""veilframe: preparing sensitive tables, and measuring how private and how
useful a synthetic copy of them is, as DataFrame operators on Spark."""

__version__ = "0.1.0"
