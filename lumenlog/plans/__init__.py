"""The query catalogue: views over the test tables, queries and their SQL counterparts."""
