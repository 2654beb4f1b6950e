"""A revision-audited store of series in Parquet tables, and comparison of versions.

Observations lie in buckets by series, so a write makes anew only the buckets of its series;
revisions, imports and metadata are only ever added to. A small numbered pointer file names what
belongs to the store, so readers see the state before a write or after it, never a mixture. A
write that finds its number taken by another one fails and changes nothing. What a write replaces
is deleted by the next write. All files go by way of Spark's file systems.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import zlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions.scalars import cutoff
from .contract import validate

#: Reserved identifiers of currency series, which must be positive, and fields of a series' metadata.
RESERVED = ("EUR_PLN", "EUR_USD", "USD_PLN")
FIELDS = ("series_id", "title", "unit", "source", "quote_semantics", "provenance")
TABLES = {
    "series": ", ".join(f"{f} string" for f in FIELDS),
    "observations": "series_id string, observation_date date, value double, updated_at timestamp",
    "revisions": "series_id string, observation_date date, old_value double, new_value double, recorded_at timestamp",
    "imports": "series_id string, recorded_at timestamp, observations long, inserted long, revised long, unchanged long",
}
BUCKETS = 64  # of observations, by crc32 of the series' identifier
FOLDERS = 64  # of a table that is added to, before they become one


def version_diff(older: DataFrame, newer: DataFrame) -> DataFrame:
    """By date: new, corrected, absent or unchanged, values compared exactly."""
    on = ["series_id", "date"]
    rows = older.select(*on, F.col("value").alias("old_value"), F.lit(True).alias("_o")).join(newer.select(*on, F.col("value").alias("new_value"), F.lit(True).alias("_n")), on, "full_outer")
    state = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "absent").when(F.col("old_value") == F.col("new_value"), "unchanged").otherwise("corrected")
    return rows.select(*on, "old_value", "new_value", state.alias("state"))


def version_diff_counts(older: DataFrame, newer: DataFrame) -> DataFrame:
    return version_diff(older, newer).groupBy("series_id", "state").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def diff_page(diff: DataFrame, page: int, size: int = 100, states: tuple[str, ...] = ("new", "corrected", "absent")) -> DataFrame:
    """One page (from 1) of a version_diff(), in order of series and date, of the given states."""
    if page < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    return diff.filter(F.col("state").isin(*states)).orderBy("series_id", "date").offset((page - 1) * size).limit(size)


def merge_keep_last(older: DataFrame, newer: DataFrame) -> DataFrame:
    """All dates of both; where both have one, the newer value."""
    rows = version_diff(older, newer)
    return rows.select("series_id", "date", F.when(F.col("state") == "absent", F.col("old_value")).otherwise(F.col("new_value")).alias("value"))


def upsert_classify(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every incoming row as inserted, revised or unchanged against the store."""
    rows = incoming.select("series_id", "date", "value").join(current.select("series_id", "date", F.col("value").alias("old_value"), F.lit(True).alias("_o")), ["series_id", "date"], "left")
    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("old_value") == F.col("value"), "unchanged").otherwise("revised")
    return rows.select("series_id", "date", "old_value", F.col("value").alias("new_value"), action.alias("action"))


def upsert_snapshot(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store's rows after the upsert; rows that the input lacks stay."""
    return merge_keep_last(current, incoming)


def series_catalog(series: DataFrame, observations: DataFrame, imports: DataFrame) -> DataFrame:
    """Each series with the number, first and last date of its observations and its last import."""
    seen = observations.groupBy("series_id").agg(F.count("*").alias("observation_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    last = imports.groupBy("series_id").agg(F.max("recorded_at").alias("last_import"))
    out = series.join(seen, "series_id", "left").join(last, "series_id", "left")
    return out.withColumn("observation_count", F.coalesce("observation_count", F.lit(0).cast("long")))


def freshness(df: DataFrame, as_of: dt.date, max_age_days: int = 7) -> DataFrame:
    """The last date up to the cutoff, its age, and whether that is more than allowed (or there is none)."""
    rows = df.groupBy("series_id").agg(F.max(F.when(F.col("date") <= F.lit(cutoff(as_of)), F.col("date"))).alias("last_date"))
    age = F.datediff(F.lit(as_of), "last_date")
    return rows.select("series_id", "last_date", age.alias("age_days"), F.coalesce(age > max_age_days, F.lit(True)).alias("stale"))


def private_path(path: str) -> str:
    """The path, made absolute where it is a local one. Raises ValueError for a place inside a checkout, links followed."""
    local = path.removeprefix("file://")
    if "://" in local:
        return path.rstrip("/")
    where = Path(local).expanduser().resolve()
    if any((p / ".git").exists() for p in (where, *where.parents)):
        raise ValueError("private data must not be inside a checkout")
    return f"file://{where}"


def bucket_of(series_id: str) -> int:
    return zlib.crc32(series_id.encode()) % BUCKETS


class Store:
    """Series, observations, revisions and imports below a private folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, private_path(path)

    def _state(self) -> dict | None:
        """What the newest whole pointer names: paths by table (observations by bucket), replaced paths, and the last batch of each stream."""
        for name in reversed([n for n in storage.names(self.spark, self.path) if n.startswith("STATE-")]):
            try:
                return json.loads(storage.read_text(self.spark, f"{self.path}/{name}")) | {"number": int(name[6:])}
            except json.JSONDecodeError:
                continue  # still being written
        return None

    def create(self) -> Store:
        if self._state() is None:
            storage.make_private(self.spark, self.path)
            self._point({"number": 0, "series": [], "observations": {}, "revisions": [], "imports": [], "replaced": [], "streams": {}})
        return self

    def _point(self, state: dict) -> None:
        """Makes a state the store's: a new pointer, one number on; fails if that number is taken."""
        number = state["number"] + 1
        storage.write_text(self.spark, f"{self.path}/STATE-{number:012d}", json.dumps({k: v for k, v in state.items() if k != "number"}))
        for name in storage.names(self.spark, self.path):
            if name.startswith("STATE-") and int(name[6:]) < number - 1:
                storage.remove(self.spark, f"{self.path}/{name}")

    def _frame(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.path}/{p}" for p in paths])

    def table(self, name: str) -> DataFrame:
        paths = self._state()[name]
        return self._frame(name, list(paths.values()) if isinstance(paths, dict) else paths)

    def read(self, series_id: str) -> DataFrame:
        """One series, from its bucket alone."""
        where = self._state()["observations"].get(str(bucket_of(series_id)))
        rows = self._frame("observations", [where] if where else []).filter(F.col("series_id") == series_id)
        return rows.select("series_id", F.col("observation_date").alias("date"), "value").orderBy("date")

    def _write(self, folder: str, tables: dict[str, DataFrame]) -> dict:
        """Writes tables to a new folder; their paths, of observations by bucket."""
        out: dict = {}
        for name, df in tables.items():
            where = f"{folder}/{name}"
            if name == "observations":
                bucket = (F.crc32(F.col("series_id").cast("binary")) % BUCKETS).cast("int")
                df.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{where}")
                out[name] = {n.removeprefix("bucket="): f"{where}/{n}" for n in storage.names(self.spark, f"{self.path}/{where}") if n.startswith("bucket=")}
            else:
                df.write.parquet(f"{self.path}/{where}")
                out[name] = [where]
        return out

    def upsert(self, metadata: list[dict], incoming: DataFrame, now: dt.datetime, stream: tuple[str, int] | None = None) -> DataFrame:
        """Checks everything, then writes all series or none. Returns the counts of each series' import.

        ``stream`` names a stream and a batch of it: a batch that was written before is not
        written again, and its call returns no rows.
        """
        for m in metadata:
            if set(m) != set(FIELDS) or any(not isinstance(v, str) or not v.strip() for v in m.values()):
                raise ValueError("a series needs exactly six fields of text")
        state = self._state()
        if stream and state["streams"].get(stream[0], -1) >= stream[1]:
            return self._frame("imports", [])
        incoming = validate(storage.staged(incoming.select("series_id", "date", "value")))
        incoming = incoming.select("series_id", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias("value"))
        if not incoming.filter(F.col("series_id").isin(*RESERVED) & (F.col("value") <= 0)).isEmpty():
            raise ValueError("currency series must be positive")
        names = [m["series_id"] for m in metadata]
        known = {r["series_id"]: r.asDict() for r in self._frame("series", state["series"]).filter(F.col("series_id").isin(names)).collect()}  # as many as the call names
        changed = [m["series_id"] for m in metadata if m["series_id"] in known and known[m["series_id"]] != m]
        if changed:
            raise ValueError(f"metadata of {', '.join(changed)} can't change")
        if not incoming.filter(~F.col("series_id").isin(names)).isEmpty():
            raise ValueError("incoming rows name a series without metadata")
        at = F.lit(now).cast("timestamp")
        touched = {str(bucket_of(s)): state["observations"].get(str(bucket_of(s))) for s in names}
        old = self._frame("observations", [p for p in touched.values() if p]).select("series_id", F.col("observation_date").alias("date"), "value", "updated_at")
        marked = storage.staged(upsert_classify(old, incoming))
        counts = marked.groupBy("series_id").agg(F.count("*").alias("observations"), *[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "revised", "unchanged")])
        counts = counts.select("series_id", at.alias("recorded_at"), "observations", "inserted", "revised", "unchanged")
        new = marked.filter("action <> 'unchanged'")
        kept = old.join(new.select("series_id", "date"), ["series_id", "date"], "left_anti")
        rows = kept.select("series_id", F.col("date").alias("observation_date"), "value", "updated_at").unionByName(new.select("series_id", F.col("date").alias("observation_date"), F.col("new_value").alias("value"), at.alias("updated_at")))
        audit = new.select("series_id", F.col("date").alias("observation_date"), "old_value", "new_value", at.alias("recorded_at"))
        fresh = [tuple(m[f] for f in FIELDS) for m in metadata if m["series_id"] not in known]
        added = {"series": self.spark.createDataFrame(fresh, TABLES["series"]), "revisions": audit, "imports": counts}
        # a table in many folders becomes one again
        whole = {k for k in added if len(state[k]) >= FOLDERS}
        tables = {k: self._frame(k, state[k]).unionByName(df) if k in whole else df for k, df in added.items()}
        made = self._write(uuid.uuid4().hex, {"observations": rows} | tables)
        gone = [p for p in touched.values() if p] + [p for k in whole for p in state[k]]
        after = {k: made[k] if k in whole else state[k] + made[k] for k in added}
        streams = state["streams"] | ({stream[0]: stream[1]} if stream else {})
        self._point({"number": state["number"], "observations": state["observations"] | made["observations"], "replaced": gone, "streams": streams} | after)
        for p in state["replaced"]:
            storage.remove(self.spark, f"{self.path}/{p}")
        return self._frame("imports", made["imports"]).filter(F.col("recorded_at") == at)

    def export(self, series_id: str, destination: str) -> None:
        """One series as a CSV file (date, instrument_id, value), which must not exist yet."""
        from ..sources.exports import write_series

        write_series(self.read(series_id), private_path(destination))

    def backup(self, destination: str) -> Store:
        """A copy of the current state in a new folder."""
        copy = Store(self.spark, destination)
        if storage.exists(self.spark, copy.path):
            raise ValueError("a backup needs a new folder")
        state = self._state()
        storage.make_private(self.spark, copy.path)
        paths = {k: list(state[k].values()) if isinstance(state[k], dict) else state[k] for k in TABLES}
        made = copy._write(uuid.uuid4().hex, {k: self._frame(k, p) for k, p in paths.items() if p})
        copy._point({"number": 0, "series": [], "observations": {}, "revisions": [], "imports": [], "replaced": [], "streams": state["streams"]} | made)
        return copy
