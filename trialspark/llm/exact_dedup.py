"""Exact deduplication by keyed streaming state.

A stream over the rows' fingerprints keeps, per digest and without expiry, one
state entry in RocksDB: rows seen, the stable identifier of the row that stays
and the locator (file and row number) of its content. Rows that hit an existing
entry are then checked on their full normalised bytes; digests shared by
different contents are split by those bytes.

Everything is DataFrame code. Equal texts meet only in aggregations with a
map-side combine and in a join whose large side AQE may split, so a digest
that holds a third of the rows does not gather in a task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from trialspark.llm.common import SPACES, shared_dir, stored, text_of

#: Disk-backed state; small stores must not reserve disk they don't fill.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    out = text_of(text)
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


#: Plan nodes that neither multiply nor combine rows: below them, a place in a file is one row.
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "View", "LogicalRelation"}


def one_row_a_place(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a file of its own, and stays that row when read again."""
    try:
        meta = docs.select(docs.metadataColumn("_metadata").alias("m")).schema["m"].dataType
    except AnalysisException:
        return False
    plan = docs._jdf.queryExecution().analyzed()
    nodes, at = [plan], 0
    while at < len(nodes):
        children = nodes[at].children()
        nodes += [children.apply(i) for i in range(children.size())]
        at += 1
    return "row_index" in meta.names and bool(plan.deterministic()) and all(n.nodeName() in ROW_BY_ROW or n.nodeName().startswith("Relation") for n in nodes)


def file_backed(docs: DataFrame) -> DataFrame:
    """``docs`` itself if its rows have places of their own in files, else a stored copy of it.

    A copy is made of rows that a step has multiplied or combined, of formats that don't number their
    rows (all but Parquet), and of rows that may differ from one reading to the next.
    """
    return docs if one_row_a_place(docs) else stored(docs, "landed")


def locator(docs: DataFrame) -> Column:
    """Struct (file, row number) of the rows of a file-backed table."""
    meta = docs.metadataColumn("_metadata")
    return F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row"))


def _order() -> Column:
    """Smallest first: most code points, then smallest id (null last), then locator."""
    return F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator")


def keyed_state(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Run the fingerprint stream at ``path`` to its end; the last state entry of each digest.

    The state store is on disk and never drops an entry. Each micro-batch
    writes the entries it changed under its own number, so a batch that is
    replayed after a failure overwrites its earlier output.
    """
    out = shared_dir(spark, "state")
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    entries = reader.parquet(path).groupBy("digest").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("group_size"))

    batches: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        query = (
            entries.writeStream.outputMode("update")
            .option("checkpointLocation", shared_dir(spark, "stream"))
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    if not batches:  # an empty table starts no batch
        return spark.createDataFrame([], entries.schema)
    seen = spark.read.schema(StructType([*entries.schema, StructField("batch", IntegerType())])).parquet(out)
    last = F.max_by(F.struct("first", "group_size"), "batch").alias("last")
    return seen.groupBy("digest").agg(last).select("digest", "last.first", "last.group_size")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest, locator.

    Needs columns doc_id and text; others are ignored, whatever their names.
    Null text counts as empty, and all empty texts are equal. Exactly one row
    of each group is kept, also among repeated rows (the first in the table);
    a null doc_id sorts last. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = file_backed(docs)
    prints_path = shared_dir(spark, "prints")
    content = normalised(docs["text"])
    whole = docs.select(
        docs["doc_id"], digest(content).alias("digest"), F.length(text_of(docs["text"])).alias("size"), locator(docs).alias("locator"), content.alias("content")
    )
    prints = whole.drop("content")
    prints.write.parquet(prints_path)
    schema = prints.schema
    state = stored(keyed_state(spark, prints_path, schema, files_per_trigger), "entries")
    prints = spark.read.schema(schema).parquet(prints_path)

    # the full bytes behind each digest; equal contents combine before the shuffle
    contents = whole.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("n"))
    shared = contents.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    shared = stored(shared, "collisions")
    if shared.isEmpty():
        return _grouped(prints.join(state, "digest"))

    mixed = whole.join(shared, "digest", "left_semi")
    by_bytes = mixed.groupBy("digest", "content").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("group_size"))
    split = _grouped(mixed.join(by_bytes, ["digest", "content"]))
    return _grouped(prints.join(shared, "digest", "left_anti").join(state, "digest")).unionByName(split)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("first.locator")).alias("kept"),
        "digest",
        "locator",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = file_backed(docs)
    kept = exact_groups(docs).where("kept").select(F.col("locator").alias("_kept"))
    return docs.join(kept, locator(docs) == kept["_kept"], "left_semi")
