"""Queries that bind the operators to tables; importing the package registers them."""

from weftline.plans import agency, aggregates, formats, joins, language, scans, streams, texts, units  # noqa: F401
