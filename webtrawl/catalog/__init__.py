"""The registered queries of the engine over the given tables."""


def _load():
    from webtrawl.catalog import (  # noqa: F401
        event_queries,
        page_queries,
        search_queries,
        stream_queries,
    )
    from webtrawl.catalog.registry import QUERIES, SQL

    return QUERIES, SQL


def all_queries():
    return dict(_load()[0])


def all_sql():
    return dict(_load()[1])
