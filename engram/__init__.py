"""PySpark engine for retrieving, linking and maintaining tables of remembered facts."""
