"""Exact deduplication with keyed state on disk.

A streaming aggregation keeps, for each digest ever seen, the identifier and the locator of the row
that stays and the number of rows. The state lives in RocksDB, is checkpointed to the shared folder and
never expires; any number of batches may follow each other. Texts never enter the state: on a hit the
texts of all rows of the digest, of earlier batches too, are read back through their locators and
compared byte by byte before they count as equal. So the files of all batches must stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import ascii_lower, join_hot, located, scanned, stored, utf8_bytes, working_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Bounded memory over all state partitions of an executor, and no disk reserved ahead for small ones.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
# Digests with a hit are looked up by this many buckets: the broadcast holds a number per bucket at most.
HIT_BUCKETS = 1 << 18

Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass(frozen=True)
class DedupStore:
    """Folder of one deduplication: landed fingerprints and the stream's checkpoint with its state."""

    spark: SparkSession
    folder: str
    digest: Digest = sha256

    @staticmethod
    def create(spark: SparkSession, folder: str | None = None, digest: Digest = sha256) -> DedupStore:
        return DedupStore(spark, folder or working_folder(spark, "exact-dedup"), digest)

    def content(self, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
        return located(docs, {"_id": F.col(id_column).cast("long"), "_text": _normal(text_column)})

    def add(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> None:
        """Take one batch: land its fingerprints, feed the state, check the bytes of the digests it has hit."""
        batch = self.land(docs, id_column, text_column)
        self.advance()
        own = self.landed().filter(F.col("_batch") == batch).select("_digest").distinct()
        hits = self.state().filter(F.col("_size") > 1).select("_digest").join(own, "_digest", "left_semi")
        found = _differing(self.texts(stored(hits, "hits")))
        found.write.mode("append").parquet(f"{self.folder}/differing")

    def land(self, docs: DataFrame, id_column: str, text_column: str) -> str:
        """Append identifier, digest, length and locator of every row; returns the name of the batch."""
        batch, digest = uuid.uuid4().hex, self.digest(F.col("_text"))
        rows = self.content(docs, id_column, text_column).select(
            "_id",
            digest.alias("_digest"),
            utf8_bytes(F.col("_text")).alias("_bytes"),
            "_file",
            "_row",
            F.lit(text_column).alias("_column"),
            F.lit(batch).alias("_batch"),
        )
        rows.write.mode("append").parquet(f"{self.folder}/landed")
        return batch

    def texts(self, digests: DataFrame) -> DataFrame:
        """``_digest, _text, _file, _row`` read from the files that hold landed rows of these digests.

        The digest is taken anew from the text, behind a broadcast filter of a number per digest bucket. Rows of these
        files that never landed may be among them; their locators tell.
        """
        bucket = F.pmod(F.xxhash64("_digest"), F.lit(HIT_BUCKETS))
        hits = F.broadcast(digests.select(bucket.alias("_bucket")).distinct())
        held = self.landed().join(digests, "_digest", "left_semi").select("_file", "_column").distinct()
        files: dict[str, list[str]] = {}
        for file, column in held.collect():
            files.setdefault(column, []).append(file)
        frames = []
        for column, paths in sorted(files.items()):
            rows = located(self.spark.read.parquet(*sorted(paths)), {"_text": _normal(column)})
            rows = rows.withColumn("_digest", self.digest(F.col("_text"))).withColumn("_bucket", bucket)
            frames.append(rows.join(hits, "_bucket", "left_semi").select("_digest", "_text", "_file", "_row"))
        if not frames:
            empty = self.landed().limit(0)
            return empty.select("_digest", F.lit("").alias("_text"), "_file", "_row")
        return reduce(DataFrame.unionByName, frames)

    def differing(self) -> DataFrame:
        """``_digest`` of digests that texts with different bytes share, over all batches."""
        try:
            return self.spark.read.parquet(f"{self.folder}/differing").distinct()
        except AnalysisException:  # nothing was added yet
            return self.landed().select("_digest").limit(0)

    def landed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/landed")

    def advance(self) -> None:
        """Feed what has landed since the last call into the state."""
        landing = self.spark.readStream.schema(self.landed().schema).parquet(f"{self.folder}/landed")
        # Ids order before locators; a null id is the smallest.
        stays = F.max(F.struct("_id", "_file", "_row", "_bytes"))
        keyed = landing.groupBy("_digest").agg(stays.alias("stays"), F.count(F.lit(1)).alias("n"))
        conf = self.spark.conf
        before = {key: conf.get(key, None) for key in STATE_CONF}
        for key, value in STATE_CONF.items():
            conf.set(key, value)
        try:
            stream = (
                keyed.writeStream.outputMode("update")
                .format("noop")
                .option("checkpointLocation", f"{self.folder}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            stream.awaitTermination()
        finally:
            for key, value in before.items():
                conf.unset(key) if value is None else conf.set(key, value)

    def state(self) -> DataFrame:
        """``_digest, _keep (struct), _size``: the state itself, one row per digest."""
        rows = self.spark.read.format("statestore").load(f"{self.folder}/checkpoint")
        keep, size = (f.name for f in rows.schema["value"].dataType.fields)
        return rows.select(
            F.col("key._digest").alias("_digest"),
            F.col("value")[keep].alias("_keep"),
            F.col("value")[size].alias("_size"),
        )


def _normal(text_column: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_column), F.lit("")))


def _differing(texts: DataFrame) -> DataFrame:
    """``_digest`` of texts that share it although their bytes differ; copies are merged before they are shuffled."""
    distinct = texts.groupBy("_digest", "_text").count()
    return distinct.groupBy("_digest").count().filter(F.col("count") > 1).select("_digest")


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", store: DedupStore | None = None
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, _file, _row``: one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. The row with the
    largest id stays, a null id being the smallest; of rows that repeat the id as well the one lying last in the
    table stays, so exactly one row per text is ``kept``. An empty table gives no rows; columns beyond
    id and text are not read. The digest column holds the store's digest, SHA-256 unless another was given.
    ``docs`` is one batch; with a ``store`` that has seen others the rows of all batches are judged and returned.
    """
    store = store or DedupStore.create(docs.sparkSession)
    store.add(docs, id_column, text_column)
    landed, state = store.landed().drop("_column", "_batch"), stored(store.state(), "dedup-state")
    decided = join_hot(landed, state, ["_digest"], "_size", landed.count(), "inner")
    differing = stored(store.differing(), "differing")
    if not differing.isEmpty():
        decided = _by_bytes(store, decided, differing)
    return decided.select(
        F.col("_id").alias(id_column),
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        ((F.col("_file") == F.col("_keep._file")) & (F.col("_row") == F.col("_keep._row"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        "_file",
        "_row",
    )


def _by_bytes(store: DedupStore, decided: DataFrame, differing: DataFrame) -> DataFrame:
    """Rows of colliding digests, whatever batch they came with, grouped by digest and bytes instead."""
    landed = store.landed().join(differing, "_digest", "left_semi").select("_id", "_bytes", "_file", "_row")
    rows = stored(store.texts(differing).join(landed, ["_file", "_row"]), "colliding")
    groups = rows.groupBy("_digest", "_text").agg(
        F.max(F.struct("_id", "_file", "_row", "_bytes")).alias("_keep"), F.count(F.lit(1)).alias("_size")
    )
    again = join_hot(rows, groups, ["_digest", "_text"], "_size", rows.count(), "inner")
    return decided.join(differing, "_digest", "left_anti").unionByName(again.select(*decided.columns))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``docs`` that exact deduplication keeps, all columns as they were.

    Nulls, empties, ties, repeated rows and empty tables as in ``exact_dedup``; names of other columns do not matter.
    """
    docs = scanned(docs)
    dropped = exact_dedup(docs, id_column, text_column).filter(~F.col("kept")).select("_file", "_row")
    marked = located(docs, {"_doc": F.struct(*docs.columns)})
    return marked.join(dropped, ["_file", "_row"], "left_anti").select("_doc.*")
