"""Ownership-change analytics on PySpark: landed records in, matched and staged deals out."""
