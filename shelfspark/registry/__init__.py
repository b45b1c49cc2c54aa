"""All registered queries and the SQL that checks them."""

from shelfspark.registry import flows, pages, queues, sequence, streams, text, urls

_MODULES = (urls, pages, queues, sequence, text, streams, flows)


def queries():
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
