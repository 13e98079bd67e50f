"""siteq: site-audit, curriculum and progress analytics as PySpark DataFrame operators."""
