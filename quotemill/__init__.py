"""Quotation attribution and corpus preparation as Spark jobs."""
