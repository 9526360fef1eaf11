"""Explicit table schemas; nothing in the engine infers a schema from data."""

from pyspark.sql import types as T

_STRING, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_BOOL, _DOUBLE, _TS = T.BooleanType(), T.DoubleType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


NODES = _struct(
    url=_STRING, title=_STRING, description=_STRING, domain=_STRING, depth=_INT, parent=_STRING,
    popularity=_INT, lang=_STRING, https=_INT, metaDescription=_STRING, ogTitle=_STRING,
    ogDescription=_STRING, contentLength=_INT, crawled_at=_LONG,
)
VISITED = _struct(url=_STRING)
FRONTIER = _struct(id=_LONG, url=_STRING, depth=_INT, parent=_STRING)
PAGES = _struct(page_id=_LONG, url=_STRING, html=_STRING)
EVENTS = _struct(
    event_id=_LONG, ts=_TS, user_id=_LONG, event_type=_STRING, value=_DOUBLE, props=_STRING
)
DOCUMENTS = _struct(doc_id=_LONG, text=_STRING, lang=_STRING, source=_STRING, n_chars=_LONG)
BENCHMARK = _struct(item_id=_LONG, text=_STRING)

FETCH_LOG = _struct(
    attempt_id=_LONG, ts=_TS, url=_STRING, domain=_STRING, ok=_BOOL, fetch_ms=_LONG, status=_INT,
    error=_STRING,
)
REQUESTS = _struct(
    request_id=_LONG, ts=_TS, client=_STRING, is_search=_BOOL, duration_ms=_LONG, status=_INT
)
URL_MESSAGE = _struct(url=_STRING, depth=_INT, parent=_STRING, enqueuedAt=_LONG)
POSTINGS = _struct(url=_STRING, field=_STRING, term=_STRING, tf=_INT)
