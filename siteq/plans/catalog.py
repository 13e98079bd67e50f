"""Every registered query by name, and the SQL that gives the same rows."""

from siteq.plans import audit_queries, curriculum_queries, page_queries, relation_queries, review_queries, shot_queries, site_queries

_MODULES = (site_queries, audit_queries, page_queries, shot_queries, review_queries, curriculum_queries, relation_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
