"""Cross-sectional panel analytics on Spark: panels, factor expressions, point-in-time data, scoring and factor libraries."""
