"""Find, mask and audit sensitive text on PySpark."""
