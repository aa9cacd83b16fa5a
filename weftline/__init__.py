"""Localization analytics and corpus preparation on Spark."""
