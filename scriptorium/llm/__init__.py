"""Training-data operators: packing, joins, deduplication, scoring, extraction, scans."""
