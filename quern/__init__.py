"""Quern: deterministic corpus preparation as PySpark DataFrame plans."""
