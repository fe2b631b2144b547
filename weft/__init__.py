"""weft: web-content analytics and hybrid retrieval as lazy PySpark plans."""
