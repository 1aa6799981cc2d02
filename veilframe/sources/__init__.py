"""Reading, writing and listing tables, reports and models."""
