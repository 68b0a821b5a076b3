"""Data mining and corpus preparation as PySpark DataFrame plans."""
