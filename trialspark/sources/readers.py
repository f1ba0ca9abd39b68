"""Bind the logical sources to stored tables.

``parquet_catalog`` reads one parquet dataset per logical source from a root
folder (``<root>/<name>``). Reads are lazy: Catalyst prunes columns and pushes
filters into each scan when an operator uses the source.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from trialspark.sources.catalog import REQUIRED, SourceCatalog


def parquet_catalog(spark: SparkSession, root: str, names: dict[str, str] | None = None) -> SourceCatalog:
    """``names`` maps a logical source to a folder name when it differs."""
    names = names or {}
    frames = {name: spark.read.parquet(f"{root}/{names.get(name, name)}") for name in REQUIRED}
    return SourceCatalog(**frames).validate().normalised()


def table_catalog(spark: SparkSession, tables: dict[str, str], normalise: bool = True) -> SourceCatalog:
    """Bind each logical source to a catalog table name (``db.table``).

    Tables written by :func:`store_bucketed` are normal already; normalising them again would hide
    their bucket columns behind expressions.
    """
    frames = {name: spark.table(tables[name]) for name in REQUIRED}
    catalog = SourceCatalog(**frames).validate()
    return catalog.normalised() if normalise else catalog


#: Key by which a source is stored: the hospital hierarchy by spell, the rest by patient.
SPELL_KEY = ["prov_unit_cd", "spell_num_pe"]
BUCKET_KEYS = {name: SPELL_KEY if name in ("spell", "episode", "diagnosis") else ["prac_cd_pe"] if name == "practice_rate" else ["alf_pe"]
               for name in REQUIRED}


def store_bucketed(catalog: SourceCatalog, database: str, buckets: int) -> dict[str, str]:
    """Write each source as a table bucketed and sorted by its join key; the table names for :func:`table_catalog`.

    Joins on those keys need no exchange. The diagnosis-episode join has the episode number as a further
    key; it stays in place with ``spark.sql.requireAllClusterKeysForCoPartition`` off, as
    ``session.SESSION_CONF`` sets it. ``buckets``: so many that a bucket of the largest source fits a task.
    """
    normal, names = catalog.normalised(), {}
    spark = normal.cohort.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, keys in BUCKET_KEYS.items():
        names[name] = f"{database}.{name}"
        df = getattr(normal, name).repartition(buckets, *keys)
        df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(names[name])
    return names
