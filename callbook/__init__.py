"""Spark jobs over trade calls, claims, bars and ledgers."""
