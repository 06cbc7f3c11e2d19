"""Registered queries over the driver's tables, each with the same rows as DuckDB SQL where SQL can express them."""
