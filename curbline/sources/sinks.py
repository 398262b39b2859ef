"""Writers for derived layers and graph tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params


def feature_lines(rows: DataFrame, properties: list[str], kind: str = "Point", line: str = "geometry", id_col: str | None = "id") -> DataFrame:
    """One map feature a row, as JSON text."""
    if kind == "Point":
        coords: Column = F.array("lon", "lat")
    else:
        coords = F.transform(F.col(line), lambda p: F.array(p["lon"], p["lat"]))
    parts = [F.lit("Feature").alias("type")]
    if id_col:
        parts.append(F.col(id_col).cast("string").alias("id"))
    parts += [F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry")]
    return rows.select(F.to_json(F.struct(*parts)).alias("value"))


def write_features(rows: DataFrame, path: str, properties: list[str], kind: str = "Point", id_col: str | None = "id", order: list[str] | None = None) -> None:
    """A feature a line. order: columns to sort by (for sites: block face, street, state), by ranges and within each."""
    rows = rows.orderBy(*order) if order else rows
    feature_lines(rows, properties, kind, id_col=id_col).write.mode("overwrite").text(path)


def write_addresses(rows: DataFrame, path: str) -> None:
    rows.select("street", "number", "unit", "postcode", "lon", "lat").write.mode("overwrite").parquet(path)


def write_graph(tables: Mapping[str, DataFrame], path: str) -> None:
    """Graph tables, each under its name; readers get them from read_graph."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def layer_counts(layers: Mapping[str, DataFrame]) -> DataFrame:
    """(layer, rows): each layer is counted once, all in one job."""
    out = None
    for name, df in layers.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def manifest(counts: DataFrame, release: str) -> DataFrame:
    """One row that describes a release and what it holds."""
    names = [v[0] for v in params.VEHICLES]
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "rows")))).alias("counts")).select(
        F.lit(release).alias("release"), F.array(*[F.lit(x) for x in params.EXTRACT_BOX]).alias("bbox"), F.current_timestamp().alias("generated_at"), "counts",
        F.lit("bicycle").alias("travel_mode"), F.array(*[F.lit(n) for n in names]).alias("vehicles"),
        F.lit(params.DEFAULT_VEHICLE).alias("default_vehicle"), F.lit(params.TOP_SPEED).alias("max_routable_speed_mph"))


def write_manifest(counts: DataFrame, release: str, path: str) -> None:
    manifest(counts, release).write.mode("overwrite").json(path)
