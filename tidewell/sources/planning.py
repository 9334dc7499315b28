"""Planning of many sources at once, as DataFrames: their configuration, URLs, axes, paging fields and page sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paged


def page_url(template: Column, page: Column, page_size: int) -> Column:
    """The URL of a page: its number or its offset put into a template, else added as a parameter."""
    number, offset = page.cast("string"), ((page - 1) * page_size).cast("string")
    added = F.concat(template, F.when(template.contains("?"), "&").otherwise("?"), F.lit("page="), number)
    filled = F.replace(F.replace(template, F.lit("{page}"), number), F.lit("{offset}"), offset)
    return F.when(template.contains("{page}") | template.contains("{offset}"), filled).otherwise(added)


def first_pages(config: DataFrame, pages: int, page_size: int = 20) -> DataFrame:
    """(name, page, url) of the first pages of every source of a configuration (name, template)."""
    rows = config.select("name", "template", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    return rows.select("name", "page", page_url(F.col("template"), F.col("page"), page_size).alias("url"))


def registered(config: DataFrame, order: str) -> DataFrame:
    """The configuration (name, ...) with the first row of each name in order, and how many others wanted the name (refused)."""
    names = Window.partitionBy("name")
    marked = config.withColumn("_n", F.row_number().over(names.orderBy(order))).withColumn("refused", F.count(F.lit(1)).over(names) - 1)
    return marked.where("_n = 1").drop("_n")


def unknown(requested: DataFrame, config: DataFrame) -> DataFrame:
    """Requested names (name) that no source has."""
    return requested.select("name").distinct().join(config.select("name"), "name", "left_anti")


def url_config(texts: DataFrame) -> DataFrame:
    """(config, name, template) of configurations (config, body: a JSON map of name to URL); names that begin with _ and blanks are left out."""
    rows = texts.select("config", F.explode(F.from_json("body", "map<string,string>")).alias("name", "template"))
    return rows.where(~F.col("name").startswith("_") & (F.col("template") != ""))


def cover(rows: DataFrame, axes: list[str], share: int) -> DataFrame:
    """(axes..., n): filters that together cover all rows where one search shows a share-th of them, split by one axis after another where there are more.

    An axis that a search need not name is null. Counts by all axes, as many as they have values, carry the rest.
    """
    counted = rows.groupBy(*axes).agg(F.count(F.lit(1)).alias("_n"))
    chosen: list[str] = []
    counted = counted.withColumn("_reach", F.floor(F.sum("_n").over(Window.partitionBy(F.lit(0))) / share))
    for axis in axes:
        over = F.sum("_n").over(Window.partitionBy(F.lit(0), *chosen)) > F.col("_reach")
        counted = counted.withColumn(f"_{axis}", F.when(over, F.col(axis)))
        chosen.append(f"_{axis}")
    return counted.groupBy(*(F.col(f"_{a}").alias(a) for a in axes)).agg(F.sum("_n").alias("n"))


def useful_axes(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(axis, n) of filters that lower the number of rows and leave some, in one pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("_whole"), *(F.count_if(test).alias(axis) for axis, test in filters.items()))
    pairs = F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("n")) for axis in filters))
    return counts.select("_whole", F.inline(pairs)).where("n > 0 AND n < _whole").select("axis", "n")


def paging_fields(probes: DataFrame) -> DataFrame:
    """(source, field): of the parameters that a source was probed with the first whose pages hold different items.

    probes: (source, field, place, page, item), the items of two or more pages asked for under each parameter.
    """
    found = probes.groupBy("source", "field", "place", "item").agg(F.countDistinct("page").alias("pages"), F.min("page").alias("page"))
    told = found.groupBy("source", "field", "place").agg(F.max("pages").alias("most"), F.countDistinct("page").alias("filled"))
    return told.where("most = 1 AND filled > 1").groupBy("source").agg(F.min_by("field", "place").alias("field"))


def page_sizes(answers: DataFrame) -> DataFrame:
    """(source, size): the largest page size that a source honoured, else the smallest asked for; answers: (source, asked, got)."""
    honoured = F.max(F.when(F.col("asked") == F.col("got"), F.col("asked")))
    return answers.groupBy("source").agg(F.coalesce(honoured, F.min("asked")).alias("size"))


def fetched(answers: DataFrame, retries: int = 3) -> DataFrame:
    """(url, body, waits): what comes of asking every URL again until it answers; answers: (url, nth, status, body), what it says each time.

    Only the first so many answers of a URL are looked at; one that is missing is none.
    """
    tried = answers.where(F.col("nth") <= retries).groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("nth", F.struct("status", "body")))).alias("said"))

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for url, said in zip(frame["url"], frame["said"], strict=True):
                waits, n, known = [], iter(range(1, retries + 1)), dict(said)

                def answer(_, known=known, n=n):
                    one = known.get(next(n))
                    return (one["status"], one["body"]) if one else (599, None)

                out.append((url, paged.fetch_with_retry(answer, url, retries, waits.append), ",".join(map(str, waits))))
            yield pd.DataFrame(out, columns=["url", "body", "waits"])

    return tried.mapInPandas(run, "url string, body string, waits string")
