"""Registered queries and the DuckDB SQL of those that SQL can express."""
