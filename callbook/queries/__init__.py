"""Queries over the derived domain tables, each with the DuckDB SQL it is checked against."""
