"""Sources of JSON documents: element lists with tags, record envelopes, and property strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELEMENTS = "struct<elements:array<struct<id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>>"


def first_tag(tags: Column, *keys: str) -> Column:
    """The first of the tags that is there and not empty, else an empty string."""
    return F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(k)), F.lit("")) for k in keys], F.lit(""))


def elements(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row for each element, with its name, state and number of tags."""
    e = documents.select(F.explode(F.from_json(body, ELEMENTS)["elements"]).alias("e"))
    tags = F.col("e.tags")
    return e.select("e.id", first_tag(tags, "name", "name:en", "name:hi").alias("name"), first_tag(tags, "is_in:state", "addr:state").alias("state"), "e.lat", "e.lon", F.coalesce(F.size(tags), F.lit(0)).cast("int").alias("n_tags")).withColumn("n_tags", F.greatest("n_tags", F.lit(0)))


def towers(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row for each tower; a tower without a type is of type unknown."""
    e = documents.select(F.explode(F.from_json(body, ELEMENTS)["elements"]).alias("e"))
    kind = F.coalesce(F.try_element_at(F.col("e.tags"), F.lit("tower:type")), F.lit("unknown"))
    return e.select("e.id", "e.lat", "e.lon", kind.alias("tower_type"))


def bodies(rows: DataFrame, group: str, element: Column) -> DataFrame:
    """A document of elements for each value of `group`, as a service answers for a region."""
    answer = F.to_json(F.struct(F.collect_list(element).alias("elements")))
    return rows.groupBy(group).agg(answer.alias("body"))


def every_nth_vertex(documents: DataFrame, body: str = "body", n: int = 5) -> DataFrame:
    """Every n-th vertex of the elements' geometries."""
    e = documents.select(F.explode(F.from_json(body, ELEMENTS)["elements"]).alias("e"))
    return e.select("e.id", F.posexplode("e.geometry").alias("k", "p")).filter(F.col("k") % n == 0).select("id", "k", "p.lat", "p.lon")


def records(documents: DataFrame, row: str, body: str = "body") -> DataFrame:
    """Rows of a service's answer, whether they stand under records, data or result.records; `row` is their struct type."""
    j = F.from_json(body, f"struct<records:array<{row}>,data:array<{row}>,result:struct<records:array<{row}>>>")
    return documents.select(F.explode(F.coalesce(j["records"], j["data"], j["result"]["records"])).alias("r")).select("r.*")


def props(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.from_json("props", "struct<k:bigint>")["k"])
