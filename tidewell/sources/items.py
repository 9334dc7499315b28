"""Items of a JSON API as a Spark data source that is asked for no more than a query needs.

The schema is the user's; an item's fields are taken by name. Filters become the source's own
parameters: ``parameters`` is a JSON map from a column to the parameter that an equal value goes to,
or to {"from": ..., "to": ...} for parameters that bound it on both sides (inclusive). What has no
parameter is left to Spark, as is a second filter on a column whose parameter is taken. With
parameters ``spark.sql.python.filterPushdown.enabled`` has to be on.

Other options are those of ``paged``, and ``total``: the path, in an answer, of how many items there
are. With it the first answer tells how many pages to read; without it ``pages`` does, and a
partition stops at its first page without items.
"""

from __future__ import annotations

import datetime
import decimal
import json
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from .paged import asked, fetcher, page_url, with_filters
from .records import record_list, walk


@dataclass
class Range(InputPartition):
    first: int
    last: int


class ItemReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = dict(options), schema
        self.asking: dict[str, str | list[str]] = {}

    def _url(self, page: int) -> str:
        return with_filters(page_url(self.options["template"], page, int(self.options.get("page_size", "20"))), self.asking)

    def _answer(self, fetch, page: int):
        body = asked(self.options, fetch, self._url(page))
        return json.loads(body) if body else None

    def partitions(self):
        pages, each = int(self.options.get("pages", "1")), int(self.options.get("pages_per_partition", "10"))
        if "total" in self.options:
            answer = self._answer(fetcher(self.options), 1)
            pages = -(-int(walk(answer, self.options["total"]) or 0) // int(self.options.get("page_size", "20"))) if answer else 0
        return [Range(a, min(a + each - 1, pages)) for a in range(1, pages + 1, each)] or [Range(1, 0)]

    def read(self, partition):
        fetch = fetcher(self.options)
        for page in range(partition.first, partition.last + 1):
            items = record_list(self._answer(fetch, page))
            if not items:
                return
            for item in items:
                yield tuple(_typed(item.get(f.name), f.dataType) for f in self.schema.fields)


class AskingReader(ItemReader):
    """Asks the source for what it has parameters for."""

    def __init__(self, options: dict[str, str], schema: T.StructType):
        super().__init__(options, schema)
        self.parameters = json.loads(options["parameters"])

    def pushFilters(self, filters: list[Filter]):
        """Takes the filters that the source has a parameter for; gives back the others."""
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        column = getattr(f, "attribute", ())
        known = self.parameters.get(column[0]) if len(column) == 1 else None
        if known is None:
            return False
        sides = known if isinstance(known, dict) else {}
        if isinstance(f, EqualTo) and not sides:
            return self._ask(known, _text(f.value))
        if isinstance(f, In) and not sides:
            return self._ask(known, [_text(x) for x in f.value]) if all(x is not None and _text(x) for x in f.value) else False
        if isinstance(f, GreaterThanOrEqual) and "from" in sides:
            return self._ask(sides["from"], _text(f.value))
        if isinstance(f, LessThanOrEqual) and "to" in sides:
            return self._ask(sides["to"], _text(f.value))
        return False

    def _ask(self, parameter: str, value: str | list[str]) -> bool:
        if parameter in self.asking or not value:  # a blank is no filter to a source
            return False
        self.asking[parameter] = value
        return True


@contextmanager
def pushing(spark):
    """What runs inside may push filters into data sources written in Python."""
    name = "spark.sql.python.filterPushdown.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def _text(value) -> str:
    return "" if value is None else str(value)


def _typed(value, kind: T.DataType):
    if value is None or value == "" and not isinstance(kind, T.StringType):
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value[:10])
    if isinstance(kind, T.TimestampType):
        return datetime.datetime.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(str(value))
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else str(value).lower() == "true"
    return int(value) if isinstance(kind, T.IntegralType) else float(value) if isinstance(kind, T.FractionalType) else value


class ItemSource(DataSource):
    @classmethod
    def name(cls):
        return "items"

    def schema(self):
        return "id long, title string"

    def reader(self, schema):
        return (AskingReader if "parameters" in self.options else ItemReader)(self.options, schema)
