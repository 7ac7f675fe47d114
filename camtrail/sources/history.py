"""Analyses at size: batches that are only ever added, with an index by key and time.

A batch is a folder of Parquet files and an index of them, a row a media item. It becomes visible when the file that
commits it appears, by one rename. Each commit is a file of its own, so writers never meet: a snapshot is all commits
but those that a later one, of a compaction, replaces. Of a media item the row that was saved last is live, whatever
batches hold it; that is decided when reading.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from camtrail.schemas import ANALYSIS
from camtrail.sources.results import RECENT, newest
from camtrail.work import file_system

STORED = T.StructType([*ANALYSIS.fields, T.StructField("saved_at", T.TimestampType()), T.StructField("batch", T.StringType())])
INDEX = "media_id string, saved_at timestamp, batch string, file string"


@dataclass
class History:
    spark: SparkSession
    folder: str

    def append(self, analyses: DataFrame, saved_at: Column | None = None, name: str | None = None) -> bool:
        """Adds a batch of analyses (ANALYSIS, and saved_at unless it is given here). A batch whose name is committed already isn't added: False."""
        name = name or uuid4().hex
        if name in self._commits():
            return False
        if saved_at is not None or "saved_at" not in analyses.columns:
            analyses = analyses.withColumn("saved_at", F.current_timestamp() if saved_at is None else saved_at)
        self._commit(name, self._stored(analyses.withColumn("batch", F.lit(name)), name), [])
        return True

    def _stored(self, rows: DataFrame, name: str) -> str:
        """Writes rows of STORED, sorted by key, and then their index; returns the folder's name, which no other attempt has.

        Rows that lie in ranges of keys already stay where they are.
        """
        attempt = f"{name}-{uuid4().hex}"
        rows.select(*STORED.fieldNames()).sort("media_id").write.parquet(f"{self.folder}/data/{attempt}")
        data = self.spark.read.schema(STORED).parquet(f"{self.folder}/data/{attempt}")
        index = data.select("media_id", "saved_at", "batch", F.concat(F.lit(f"{attempt}/"), F.col("_metadata.file_name")).alias("file"))
        index.write.parquet(f"{self.folder}/index/{attempt}")
        return attempt

    def _commit(self, name: str, attempt: str, replaced: list[str]) -> None:
        system, target = file_system(self.spark, f"{self.folder}/commits/{name}.json")
        _, begun = file_system(self.spark, f"{self.folder}/commits/.{attempt}")
        out = system.create(begun, True)
        out.write(bytearray(json.dumps({"folder": attempt, "replaces": replaced}).encode()))
        out.close()
        if not system.rename(begun, target) and not system.exists(target):
            raise OSError(f"batch {name} can't be committed")

    def _commits(self) -> dict[str, dict]:
        """Name and contents of each commit; one small file a batch, until they are compacted."""
        system, folder = file_system(self.spark, f"{self.folder}/commits")
        if not system.exists(folder):
            return {}
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        read = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString
        found = {}
        for name in names:
            if name.endswith(".json") and not name.startswith("."):
                stream = system.open(file_system(self.spark, f"{self.folder}/commits/{name}")[1])
                found[name[:-5]] = json.loads(read(stream, "UTF-8"))
                stream.close()
        return found

    def _live(self) -> dict[str, str]:
        """Name and folder of the batches of the snapshot."""
        commits = self._commits()
        gone = {r for c in commits.values() for r in c["replaces"]}
        return {name: c["folder"] for name, c in commits.items() if name not in gone}

    def _index(self) -> DataFrame:
        """media_id, saved_at, batch and file of every stored row; only what a query filters on is read."""
        folders = [f"{self.folder}/index/{f}" for f in self._live().values()]
        return self.spark.read.schema(INDEX).parquet(*folders) if folders else self.spark.createDataFrame([], INDEX)

    def read(self, *columns: Column | str) -> DataFrame:
        """The live analysis of each media item, with saved_at and batch, or the columns made of it.

        Columns are made of a stored row before it meets others of its media item: what they leave out isn't shuffled.
        """
        return self._merged(self._rows(list(self._live().values())), columns)

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*(f"{self.folder}/data/{f}" for f in folders)) if folders else self.spark.createDataFrame([], STORED)

    def _merged(self, rows: DataFrame, columns: tuple[Column | str, ...] = ()) -> DataFrame:
        others = [c for c in STORED.fieldNames() if c != "media_id"]
        made = rows.select("media_id", F.struct("saved_at", "batch").alias("_at"), F.struct(*(columns or others)).alias("_row"))
        latest = made.groupBy("media_id").agg(F.max_by("_row", "_at").alias("_row"))
        return latest.select("_row.*") if columns else latest.select("media_id", "_row.*")

    def _files(self, chosen: list) -> DataFrame:
        """The rows that an index's rows tell of; no file is opened but theirs."""
        rows = self.spark.read.schema(STORED).parquet(*sorted({f"{self.folder}/data/{r['file']}" for r in chosen}))
        own = F.lit(False)
        for r in chosen:  # `limit` of them
            own = own | ((F.col("media_id") == r["media_id"]) & (F.col("batch") == r["batch"]))
        return rows.where(own)

    def get(self, media_id: str) -> DataFrame | None:
        """The live analysis of one media item as a one-row table, or None. The index, filtered by key, names one file."""
        own = self._index().where(F.col("media_id") == media_id).orderBy(F.desc("saved_at"), F.desc("batch")).limit(1).collect()
        return self._files(own).select(*ANALYSIS.fieldNames()) if own else None

    def recent(self, limit: int = RECENT) -> DataFrame:
        """The media items saved last, newest first, with saved_at; among equals the smaller media_id. At most `limit` files are opened."""
        latest = self._index().groupBy("media_id").agg(F.max(F.struct("saved_at", "batch", "file")).alias("at")).select("media_id", "at.*")
        chosen = newest(latest, "saved_at", "media_id", limit).collect()  # `limit` rows
        if not chosen:
            return self.spark.createDataFrame([], STORED).drop("batch")
        return newest(self._files(chosen).drop("batch"), "saved_at", "media_id", limit)

    def compact(self) -> None:
        """Replaces the batches of a snapshot by one of their live rows. What is added meanwhile stays beside it; rows that two compactions hold are equal."""
        live = self._live()
        if len(live) < 2:
            return
        name = f"compact-{uuid4().hex}"
        ranged = self._rows(list(live.values())).repartitionByRange("media_id")  # one shuffle, for merging and for sorted files
        self._commit(name, self._stored(self._merged(ranged), name), sorted(live))
