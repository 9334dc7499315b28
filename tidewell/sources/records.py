"""Records out of JSON answers whose shape is found out, not known."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Where answers keep their rows.
HOLDERS = ("items", "data", "results", "records", "rows", "content", "hits")


def longest_list(body: Column, need: str = "id") -> Column:
    """How many objects with a certain key the longest such list of an answer has, in Arrow batches."""
    @F.pandas_udf("long")
    def size(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: len(record_list(json.loads(b), need)) if b else 0)

    return size(body)


def changed_at(body: Column, path: str, new: Column) -> Column:
    """An answer with the value at a dotted path replaced, in Arrow batches; read one back with get_json_object."""
    @F.pandas_udf("string")
    def change(bodies: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(put(json.loads(b), path, v), ensure_ascii=False) for b, v in zip(bodies, values, strict=True)])

    return change(body, new)


def merged_settings(old: Column, patch: Column) -> Column:
    """A map with a patch laid over: the patch's keys count, others stay."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(patch, k)), patch)


def filtered_url(base: str, filters: dict[str, Column]) -> Column:
    """A source-side predicate as a URL: filters as query parameters, blanks left out."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}="), F.url_encode(v))) for name, v in filters.items()]
    return F.concat_ws("&" if "?" in base else "?", F.lit(base), F.nullif(F.concat_ws("&", *parts), F.lit("")))


def record_list(value, need: str = "id", depth: int = 6) -> list[dict]:
    """The longest list of objects with a certain key, anywhere in a value."""
    best: list[dict] = []
    waiting = [(value, depth)]
    while waiting:
        at, left = waiting.pop()
        if isinstance(at, list):
            rows = [x for x in at if isinstance(x, dict)]
            if rows and len(rows) > len(best) and all(need in x for x in rows):
                best = rows
        if left:
            inner = at.values() if isinstance(at, dict) else at if isinstance(at, list) else ()
            waiting += [(x, left - 1) for x in inner if isinstance(x, (dict, list))]
    return best


def first_value(record: dict, needles: list[str]) -> str:
    """The first non-blank value whose key holds a needle; keys of ids don't count, lists join names."""
    for needle in needles:
        for key, value in record.items():
            low = key.lower()
            if needle not in low or low.endswith(("id", "ids")):
                continue
            if isinstance(value, dict):
                value = value.get("name") or value.get("title") or ""
            if isinstance(value, list):
                value = ", ".join(str(x.get("name", "") if isinstance(x, dict) else x) for x in value if x)
            if value not in (None, ""):
                return str(value)
    return ""


def walk(value, path: str):
    """The value at a dotted path, else None."""
    for step in path.split("."):
        if isinstance(value, list) and step.isdigit() and int(step) < len(value):
            value = value[int(step)]
        elif isinstance(value, dict):
            value = value.get(step)
        else:
            return None
    return value


def put(value: dict, path: str, new) -> dict:
    """A copy with the value at a dotted path replaced."""
    head, _, rest = path.partition(".")
    return {**value, head: put(value.get(head) or {}, rest, new) if rest else new}


def records(answers: DataFrame, wanted: dict[str, list[str]], column: str = "body") -> DataFrame:
    """Rows of all answers with the wanted columns, each found by the needles for it; in Arrow batches."""
    schema = "answer long, " + ", ".join(f"{c} string" for c in wanted)

    def run(batches):
        for frame in batches:
            out = []
            for answer, body in zip(frame["answer"], frame[column], strict=True):
                try:
                    found = record_list(json.loads(body))
                except (TypeError, ValueError):
                    continue
                out += [(answer, *(first_value(r, needles) for needles in wanted.values())) for r in found]
            yield pd.DataFrame(out, columns=["answer", *wanted])

    return answers.select("answer", column).mapInPandas(run, schema)


def shape(body: Column) -> Column:
    """The holder under which an answer keeps at least three rows with a title, else null."""
    tests = []
    for name in HOLDERS:
        rows = F.from_json(F.get_json_object(body, f"$.{name}"), "array<struct<title:string,name:string>>")
        tests.append(F.when((F.size(rows) >= 3) & F.exists(rows, lambda r: F.coalesce(r["title"], r["name"]).isNotNull()), name))
    return F.coalesce(*tests)


POSTS = "array<struct<id:long,link:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,class_list:array<string>>>"


def wordpress_posts(answers: DataFrame, column: str = "body") -> DataFrame:
    """(answer, id, title, url, summary, country): posts of a WordPress answer, in generated code."""
    rows = answers.select("answer", F.explode(F.from_json(column, POSTS)).alias("p"))
    plain = lambda c: text.squeezed(text.unescaped(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<[^>]*>", " ")))
    title = plain(F.col("p.title.rendered"))
    return rows.select("answer", F.col("p.id").alias("id"), title.alias("title"), F.col("p.link").alias("url"), plain(F.col("p.excerpt.rendered")).alias("summary"), text.suffix_country(title).alias("country"))


def key_needle(map_column: Column, needle: str) -> Column:
    """The first value of a map whose key holds a needle and isn't an id."""
    found = F.filter(F.map_entries(map_column), lambda e: F.lower(e["key"]).contains(needle) & ~F.lower(e["key"]).rlike("ids?$") & (F.coalesce(e["value"], F.lit("")) != ""))
    return F.when(F.size(found) > 0, found[0]["value"])
