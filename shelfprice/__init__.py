"""Retail price comparison as DataFrame-to-DataFrame operators on Spark."""
