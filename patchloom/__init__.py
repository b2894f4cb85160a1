"""Change-risk analytics and large-corpus operators as PySpark plans."""
