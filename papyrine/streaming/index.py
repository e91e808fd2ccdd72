"""An index of near-copy sketches that grows by batches: versioned segments, tombstones, and commits that can be repeated.

A batch of changes (doc_id, text, deleted, at) becomes a delta of its batch's number: the sketches of what was added or
changed and the ids of what was removed. A delta counts once its commit is written, last; a batch that comes again finds its
commit and changes nothing, one that was cut off writes its delta anew. Of a document the newest delta counts. ``compact``
writes what counts as a base, which stands for all deltas up to its number; older ones are left for the usual retention.

Edge cases: of several changes of a document in one batch the last by ``at`` counts, of equally late ones a removal; a null
doc_id is left out; a null text is indexed as an empty one; removing what isn't there does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from papyrine.operators.minhash import sketches

ENTRY = "class long, size long, bands array<long>"
COMMIT = "kind string, version long"


class Index:
    """The index in a folder that driver and executors share; ``key`` is the type of doc_id."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "string"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def commits(self) -> list[tuple[str, int]]:
        """(kind, version) of the newest base and the deltas after it."""
        if not self._exists(f"{self.folder}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{self.folder}/commits").distinct()
        base = rows.where("kind = 'base'").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        return sorted(tuple(r) for r in rows.where((F.col("version") > base) & (F.col("kind") == "delta") | (F.col("version") == base) & (F.col("kind") == "base")).collect())

    def _commit(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}-{version}")
        self.spark.createDataFrame([(kind, version)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{self.folder}/commits/{kind}-{version}")

    def apply(self, changes: DataFrame, version: int) -> None:
        """Add a batch of changes as the delta ``version``; nothing if it is there already."""
        if self._exists(f"{self.folder}/commits/delta-{version}/_SUCCESS"):
            return
        last = F.max_by(F.struct("text", "deleted"), F.struct("at", "deleted", "text"))
        newest = changes.where("doc_id IS NOT NULL").withColumn("deleted", F.coalesce("deleted", F.lit(False))).groupBy("doc_id").agg(last.alias("x")).select(F.col("doc_id").cast(self.key), "x.text", "x.deleted")
        added = sketches(newest.where("NOT deleted")).withColumn("deleted", F.lit(False))
        removed = newest.where("deleted").select("doc_id", *(F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in ENTRY.split(", "))), "deleted")
        self._commit(added.unionByName(removed), "delta", version)

    def read(self) -> DataFrame:
        """(doc_id, class, size, bands) of the documents that count."""
        schema = f"doc_id {self.key}, {ENTRY}, deleted boolean"
        found = self.spark.createDataFrame([], f"{schema}, version long")
        for kind, version in self.commits():
            found = found.unionByName(self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}-{version}").withColumn("version", F.lit(version).cast("long")))
        newest = found.groupBy("doc_id").agg(F.max("version").alias("version"))  # only numbers are exchanged for this
        return found.join(newest, ["doc_id", "version"]).where("NOT deleted").drop("version", "deleted")

    def compact(self) -> None:
        known = self.commits()
        if known and not (len(known) == 1 and known[0][0] == "base"):
            version = max(v for _, v in known)
            self._commit(self.read().withColumn("deleted", F.lit(False)), "base", version)

    def candidates(self, docs: DataFrame) -> DataFrame:
        """(doc_id, other_id, shared) of indexed documents that share at least one band of their signatures with ``docs``' (doc_id, text)."""
        asked = sketches(docs).where("size > 0").select("doc_id", F.explode("bands").alias("band"))
        held = self.read().where("size > 0").select(F.col("doc_id").alias("other_id"), F.explode("bands").alias("band"))
        return asked.join(held, "band").groupBy("doc_id", "other_id").agg(F.count("*").alias("shared"))


def index_stream(changes: DataFrame, index: Index, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep ``index`` up to date with a stream of changes; the checkpoint's batch numbers are the versions."""
    writer = changes.writeStream.foreachBatch(lambda batch, number: index.apply(batch, number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def processed_text() -> Column:
    """The abstract and the sections' text of a processed document."""
    return F.concat_ws("\n\n", "abstract", F.array_join(F.transform("sections", lambda s: s["summary"]), "\n\n"))


def processed_changes(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Processed JSON documents as additions, as they arrive: their abstract and their sections' text."""
    from papyrine.sources.papers import PROCESSED

    found = spark.readStream.schema(PROCESSED).option("multiLine", True).option("maxFilesPerTrigger", files).json(folder)
    return found.select("doc_id", processed_text().alias("text"), F.lit(False).alias("deleted"), F.col("_metadata.file_modification_time").alias("at"))
