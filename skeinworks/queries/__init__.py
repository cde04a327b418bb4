"""Registered queries over the test tables, each with the SQL that it equals where there is one."""

from . import access, changes, content, filtering, indexes, jobs, more, ranking, stores, streams

QUERIES: dict = {}
ORACLE: dict = {}
for _m in (filtering, changes, content, ranking, access, jobs, stores, streams, more, indexes):
    QUERIES.update(_m.reg.queries)
    ORACLE.update(_m.reg.sql)
