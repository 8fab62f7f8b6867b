"""Case store and case queries.

The store hashes cases into buckets. A write reads and rewrites only the buckets
it touches, as files in a folder of its own, and publishes a manifest that names
each bucket's current folder; a reader sees one manifest, so never a half-written
store, and a failed job leaves the previous version as it was. Manifests are
claimed exclusively: of two writers of one version the second one starts again
from the first one's result; a claim whose writer died lapses after ``lease`` seconds. ``expire`` deletes what no kept manifest names.
"Last write wins" is the greatest ``(version, row)`` per ``case_id``: a partial
aggregate, so a case id repeated by millions of versions is still combined
map-side before the shuffle. Row versions are issued by the store, so writers
(batch runs, streams, restarts) need no common clock; a manifest's name
also records which stream batch it holds, which outlives any process.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.config import EXPOSURE_PER_MULE_LAKH, MULES_PER_CAMPAIGN, MULES_PER_COMMUNITY
from riskspark.session import ensure_checkpoint_dir

CASE_SCHEMA = ("case_id string, account_id long, risk_score double, severity string, typology string, "
               "confidence double, is_demo boolean, version long, report string")


def latest_versions(cases: DataFrame, key: str = "case_id", version: str = "version") -> DataFrame:
    """One row per case, the highest version; of rows with one version the greatest
    by their other columns in order, so the choice never depends on the partitioning."""
    others = [c for c in cases.columns if c not in (key, version)]
    return (cases.groupBy(key).agg(F.max(F.struct(version, *others)).alias("_r"))
            .select(key, "_r.*").select(*cases.columns))


def upsert(existing: DataFrame, new: DataFrame, key: str = "case_id", version: str = "version") -> DataFrame:
    """Merge new rows over existing ones, last write (highest version) wins."""
    return latest_versions(existing.unionByName(new, allowMissingColumns=True), key, version)


def list_cases(cases: DataFrame) -> DataFrame:
    """A14 + K2: all cases, risk descending, ties by case id."""
    return cases.orderBy(F.col("risk_score").desc(), F.col("case_id"))


def get_case(cases: DataFrame, case_id: str) -> DataFrame:
    """Point lookup (empty when absent)."""
    return cases.where(F.col("case_id") == F.lit(case_id))


def clear_uploaded(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep demo cases; also return ``(kept, removed)`` counts as a one-row frame."""
    kept = cases.where(F.col("is_demo"))
    counts = cases.agg(F.count_if(F.col("is_demo")).alias("kept"),
                       F.count_if(~F.col("is_demo")).alias("removed"))
    return kept, counts


def new_cases(existing: DataFrame, candidates: DataFrame, key: str = "case_id") -> DataFrame:
    """Candidates not in the store yet (left anti join)."""
    return candidates.join(existing.select(key), key, "left_anti")


def lookup_with_fallback(sources: list[tuple[int, DataFrame]], key: str = "case_id") -> DataFrame:
    """Union of sources tagged by priority; per case the lowest priority number wins."""
    tagged = None
    for prio, df in sources:
        part = df.select("*", F.lit(prio).alias("_prio"))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    others = [c for c in tagged.columns if c not in (key, "_prio")]
    best = tagged.groupBy(key).agg(F.min_by(F.struct(*[F.col(c) for c in others], F.col("_prio")),
                                            F.col("_prio")).alias("_r"))
    return best.select(key, "_r.*")


def high_severity(cases: DataFrame) -> DataFrame:
    """CRITICAL or HIGH cases."""
    return cases.where(F.col("severity").isin("CRITICAL", "HIGH"))


def dashboard_kpis(cases: DataFrame) -> DataFrame:
    """Totals, CRITICAL+HIGH count, rounded mean risk, exposure and campaigns."""
    agg = cases.agg(F.count(F.lit(1)).alias("total"),
                    F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("mules"),
                    F.avg("risk_score").alias("avg_risk"))
    return agg.select(
        "total", "mules",
        F.when(F.col("total") > 0, F.round(F.col("avg_risk"), 0)).otherwise(F.lit(0.0)).cast("long")
        .alias("avg_risk"),
        (F.col("mules") * F.lit(EXPOSURE_PER_MULE_LAKH)).alias("exposure_lakh"),
        F.greatest(F.lit(1), F.ceil(F.col("mules") / F.lit(MULES_PER_CAMPAIGN))).cast("long")
        .alias("active_campaigns"))


def analytics_kpis(flagged: DataFrame) -> DataFrame:
    """Networks, prevented exposure and communities from the real flagged count."""
    n = F.count(F.lit(1))
    return flagged.agg(
        n.alias("flagged"),
        F.ceil(n / F.lit(MULES_PER_CAMPAIGN)).cast("long").alias("networks_disrupted"),
        (n * F.lit(EXPOSURE_PER_MULE_LAKH)).alias("fraud_prevented_lakh"),
        F.ceil(n / F.lit(MULES_PER_COMMUNITY)).cast("long").alias("high_risk_communities"))


class CaseStore:
    """Bucketed, versioned parquet store of cases under a shared folder.

    ``buckets`` is fixed when a store is first written and read from its manifests later.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, lease: float = 60.0):
        self.spark, self.root, self.buckets, self.lease = spark, root.rstrip("/"), buckets, lease

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._path(folder)
        return [st.getPath().getName() for st in fs.listStatus(path)] if fs.exists(path) else []

    def _numbered(self) -> list[tuple[int, str]]:
        """Every manifest, complete or not, in order: number and stream batch (empty for other writes)."""
        names = [n[2:].partition("+") for n in self._names("manifests") if n.startswith("v=")]
        return sorted((int(number), batch) for number, _, batch in names)

    def _manifest(self, version: int, batch: str) -> dict | None:
        """A manifest's content; None if its writer died before its end."""
        fs, path = self._path(f"manifests/{self._name(version, batch)}")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _published(self) -> list[tuple[int, str]]:
        """Complete versions in order."""
        return [v for v in self._numbered() if self._manifest(*v) is not None]

    def _current(self) -> dict:
        """The newest complete manifest."""
        for version in reversed(self._numbered()):
            found = self._manifest(*version)
            if found is not None:
                return found
        return {"buckets": self.buckets, "folders": {}}

    def has_batch(self, batch: str) -> bool:
        return any(b == batch for _, b in self._published())

    @staticmethod
    def _name(version: int, batch: str) -> str:
        return f"v={version}+{batch}" if batch else f"v={version}"

    def _read(self, manifest: dict, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in sorted(manifest["folders"].items())
                 if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], CASE_SCHEMA)
        return self.spark.read.schema(CASE_SCHEMA).parquet(*paths)

    def read(self) -> DataFrame:
        """The newest complete version; an absent store reads as empty."""
        return self._read(self._current())

    def _next(self) -> int:
        numbered = self._numbered()
        return numbered[-1][0] + 1 if numbered else 1

    def _publish(self, version: int, batch: str, manifest: dict) -> bool:
        """Create the manifest; False if another writer has the version."""
        if any(n >= version for n, _ in self._numbered()):
            return False
        # the number is claimed by a file of its own, as names also carry the batch
        since = time.monotonic()
        fs, claim = self._path(f"claims/v={version}")
        if not fs.createNewFile(claim) or time.monotonic() - since > self.lease / 2:
            return False
        fs, path = self._path(f"manifests/{self._name(version, batch)}")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def _write(self, change: Callable[[dict, int], tuple[DataFrame, set[str]]], batch: str = "") -> int:
        """Replace the buckets that ``change(manifest, version)`` returns by its rows, as the next version."""
        while True:
            current, version = self._current(), self._next()
            if self._claimed(version):
                self._await(version)
                if self._next() > version:
                    continue
                while self._claimed(version):
                    version += 1
            rows, touched = change(current, version)
            folder = f"{version}-{uuid.uuid4().hex}"
            bucket = F.pmod(F.xxhash64("case_id"), F.lit(current["buckets"]))
            (rows.withColumn("bucket", bucket).repartition("bucket")
             .write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}"))
            kept = {b: f for b, f in current["folders"].items() if b not in touched}
            written = {n.partition("=")[2]: folder for n in self._names(f"data/{folder}") if n.startswith("bucket=")}
            if self._publish(version, batch, {"buckets": current["buckets"], "folders": {**kept, **written}}):
                return version

    def _await(self, version: int) -> None:
        """Give the writer that claimed a version its time to publish it."""
        until = time.monotonic() + self.lease
        while self._next() <= version and time.monotonic() < until:
            time.sleep(min(0.2, self.lease))

    def _claimed(self, version: int) -> bool:
        """Without a manifest after the lease the writer died; the number is left out for good."""
        fs, claim = self._path(f"claims/v={version}")
        return fs.exists(claim)

    def save(self, new: DataFrame, batch: str = "") -> int:
        """Upsert as the next version; a stream batch that is published already is skipped."""
        if batch and self.has_batch(batch):
            return self._published()[-1][0]
        ensure_checkpoint_dir(self.spark)
        rows = new.checkpoint()

        def change(current: dict, version: int) -> tuple[DataFrame, set[str]]:
            bucket = F.pmod(F.xxhash64("case_id"), F.lit(current["buckets"])).cast("string")
            touched = {r[0] for r in rows.select(bucket).distinct().collect()}  # at most one row per bucket
            versioned = rows.withColumn("version", F.lit(version).cast("long"))
            return upsert(self._read(current, touched), versioned), touched

        return self._write(change, batch)

    def seed(self, demo: DataFrame) -> int:
        """Upsert demo cases, return how many were new."""
        fresh = new_cases(self.read(), demo).count()
        self.save(demo)
        return fresh

    def clear_uploaded(self) -> int:
        """Keep only demo cases; return the number removed."""
        removed = 0

        def change(current: dict, version: int) -> tuple[DataFrame, set[str]]:
            nonlocal removed
            kept, counts = clear_uploaded(self._read(current))
            removed = int(counts.first()["removed"])
            return kept, set(current["folders"])

        self._write(change)
        return removed

    def expire(self, keep: int = 3) -> int:
        """Delete all but the ``keep`` newest versions and the files that only the others name;
        returns how many folders went. Folders of writers still at work are newer, so they stay."""
        published = self._published()
        old, kept = published[:-keep], published[-keep:]
        if not old:
            return 0
        named = {f for v in kept for f in self._manifest(*v)["folders"].values()}
        for v in old:
            fs, path = self._path(f"manifests/{self._name(*v)}")
            fs.delete(path, False)
        gone = [f for f in self._names("data") if int(f.partition("-")[0]) < kept[0][0] and f not in named]
        for folder in gone:
            fs, path = self._path(f"data/{folder}")
            fs.delete(path, True)
        return len(gone)
