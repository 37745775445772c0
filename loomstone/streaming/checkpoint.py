"""An append-only checkpoint of whole batches with its run log, published together or not at all.

Rows and run log of an append are written to new folders that nobody reads yet. Then one small manifest with the next number is created, which fails if another writer
has it; what manifests name is the checkpoint. A crash before that leaves folders that are never read, a replay after it finds its batches complete and adds nothing.
On stores without exclusive creation, one writer at a time has to be ensured by other means.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_, or_

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomstone.operators.review import rows_digest

#: Bad batches named in an error.
NAMED = 20
#: Times that an append begins anew because another writer was faster.
ATTEMPTS = 5


class Checkpoint:
    """Batches at a path that all executors share. Rows have a batch column and keys that are unique over all batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def commits(self) -> list[dict]:
        """Manifests in order: one for each append that added something."""
        at = self._at("commits")
        if not self._fs.exists(at):
            return []
        numbers = sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())
        texts = {int(r["path"].rsplit("/", 1)[1]): r["value"] for r in self.spark.read.text(f"{self.path}/commits", wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).collect()} if numbers else {}
        return [json.loads(texts[n]) | {"number": n} for n in numbers if n in texts]

    def _tables(self, kind: str) -> DataFrame | None:
        done = self.commits()
        if not done:
            return None
        number = F.create_map(*(F.lit(x) for c in done for x in (c["folder"], c["number"])))
        rows = self.spark.read.parquet(*(f"{self.path}/{kind}/{c['folder']}" for c in done))
        return rows.withColumn("commit", number[F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1)])

    def read(self) -> DataFrame | None:
        """All rows with the number of their commit; None before the first one."""
        return self._tables("rows")

    def runs(self) -> DataFrame | None:
        """A row for each batch: batch, row_count, digest, collected_at, commit."""
        return self._tables("runs")

    def append(self, batches: DataFrame, key: list[str], batch: str = "batch_id") -> dict[str, int]:
        """Add the batches that are new: how many rows and batches were added.

        A batch all of whose rows are there with equal values is complete and passed over. ValueError, and nothing is added, if a row is there with other values, a batch is there in part or
        was added with other rows, or a key comes twice.
        """
        folder = f"c-{uuid.uuid4().hex}"
        batches.write.parquet(f"{self.path}/rows/{folder}")  # one evaluation; checked and published from here
        staged = self.spark.read.schema(batches.schema).parquet(f"{self.path}/rows/{folder}")
        try:
            for _ in range(ATTEMPTS):
                if (added := self._publish(staged, folder, key, batch)) is not None:
                    return added
        except BaseException:
            self._fs.delete(self._at(f"rows/{folder}"), True)
            raise
        self._fs.delete(self._at(f"rows/{folder}"), True)
        raise RuntimeError(f"another writer was faster {ATTEMPTS} times")

    def _publish(self, staged: DataFrame, folder: str, key: list[str], batch: str) -> dict[str, int] | None:
        done = self.commits()
        there, runs = self.read(), self.runs()
        twice = staged.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").limit(NAMED).collect()
        if twice:
            raise ValueError(f"keys that come twice: {[tuple(r[k] for k in key) for r in twice]}")
        flags = {"__there": F.lit(False), "__differs": F.lit(False)}
        compared = staged.withColumns(flags)
        if there is not None:
            old = there.select(*(F.col(c).alias(f"__{c}") for c in staged.columns), F.lit(True).alias("__old"))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
            differs = reduce(or_, [~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in staged.columns if c not in key], F.lit(False))
            found = F.col("__old").isNotNull()
            compared = staged.join(old, reduce(and_, same), "left").select(*staged.columns, found.alias("__there"), (found & differs).alias("__differs"))
        by_batch = compared.groupBy(batch).agg(F.count("*").alias("row_count"), rows_digest(sorted(staged.columns)).alias("digest"), F.count_if("__there").alias("there"), F.count_if("__differs").alias("differing"))
        if runs is not None:
            before = runs.select(F.col(batch).alias("__batch"), F.col("row_count").alias("rows_before"))
            by_batch = by_batch.join(before, F.col(batch).eqNullSafe(F.col("__batch")), "left").drop("__batch")
        else:
            by_batch = by_batch.withColumn("rows_before", F.lit(None).cast("long"))
        known = F.coalesce(F.col("rows_before"), F.lit(0))
        in_part = F.when(F.col("there") == 0, known > 0).otherwise(F.col("there") < F.col("row_count"))
        bad = by_batch.filter((F.col("differing") > 0) | in_part).limit(NAMED).collect()
        if bad:
            told = "; ".join(f"{r[batch]}: {r['there']} of {r['row_count']} rows are there, {r['differing']} with other values" for r in bad)
            raise ValueError(f"batches that can't be added: {told}")
        fresh = by_batch.filter("there = 0").select(batch, "row_count", "digest", F.current_timestamp().alias("collected_at"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/runs/{folder}")
        fresh = self.spark.read.parquet(f"{self.path}/runs/{folder}")
        n_batches, n_rows = fresh.agg(F.count("*"), F.coalesce(F.sum("row_count"), F.lit(0))).first()
        if not n_batches:
            for kind in ("rows", "runs"):
                self._fs.delete(self._at(f"{kind}/{folder}"), True)
            return {"rows": 0, "batches": 0}
        out = folder
        if n_rows < staged.count():  # some batches are complete already
            out = f"{folder}-new"
            staged.join(fresh.select(F.col(batch).alias("__batch")), F.col(batch).eqNullSafe(F.col("__batch")), "left_semi").write.mode("overwrite").parquet(f"{self.path}/rows/{out}")
            fresh.write.mode("overwrite").parquet(f"{self.path}/runs/{out}")
        if not self._claim(max([0, *(c["number"] for c in done)]) + 1, {"folder": out, "rows": n_rows, "batches": n_batches}):
            return None
        if out != folder:
            for kind in ("rows", "runs"):
                self._fs.delete(self._at(f"{kind}/{folder}"), True)
        return {"rows": n_rows, "batches": n_batches}

    def _claim(self, number: int, manifest: dict) -> bool:
        """Create the manifest of that number; False if there is one. It is written under another name first, so that no reader meets half of it."""
        draft, at = self._at(f"drafts/{manifest['folder']}"), self._at(f"commits/{number:09d}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        stream.close()
        self._fs.mkdirs(at.getParent())
        if self._fs.exists(at):
            return False
        try:
            return bool(self._fs.rename(draft, at))
        except (PySparkException, OSError):
            return False


def follow(stream: DataFrame, path: str, key: list[str], checkpoint: str, batch: str = "batch_id") -> StreamingQuery:
    """Fill the checkpoint from a stream of files that hold whole batches; a micro-batch that comes again after a crash adds nothing."""
    return stream.writeStream.foreachBatch(lambda rows, _: Checkpoint(rows.sparkSession, path).append(rows, key, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
