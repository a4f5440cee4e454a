"""Mempool snapshot analytics on PySpark: sources, operators, plans and streams."""
