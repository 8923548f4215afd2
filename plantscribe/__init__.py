"""A PySpark engine for industrial document analytics."""
