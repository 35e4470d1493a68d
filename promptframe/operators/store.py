"""The result store: append-only bucketed Parquet tables in a shared folder.

Each append is one folder ``batch=...`` that readers take only after Spark has
committed it (``_SUCCESS``), so a lost job leaves nothing half-visible. Nothing is ever
rewritten: an expiry appends keys, and a record older than its key's expiry is dead.

All batches of a table have the same number of buckets by key, chosen by the first one
(the shuffle partitions of its session) and kept in the folders' names. A session knows
the folders as partitions of one bucketed table, so whatever is grouped or joined by key
reads its buckets in place: the store's side of a lookup is never shuffled. Keys are
digests, so buckets are even whatever the data. One call finds the committed batches.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptframe.operators import lookup
from promptframe.operators.lookup import KEYS
from promptframe.operators.usage import USAGE_TYPE
from promptframe.session import glob_paths

RESULT_SCHEMA = (
    "hash_prefix string, prompt_hash string, run_hash string, prompt string, response string, "
    f"usage {USAGE_TYPE}, timestamp string, written_at timestamp, elapsed_time double, "
    "module_name string, module_version string, module_args_json string, "
    "params map<string,string>, batch_id string, error string, prompt_ok boolean"
)
PROMPT_SCHEMA = "hash_prefix string, prompt_hash string, prompt string, written_at timestamp"
PENDING_SCHEMA = (
    "hash_prefix string, prompt_hash string, run_hash string, state string, body string, "
    "batch_id string, prompt string, params map<string,string>, module_name string, "
    "module_version string, module_args_json string, timestamp string, written_at timestamp"
)
LEDGER_SCHEMA = "run_hash string, run_id string, wave int, served int, cost decimal(38,12), written_at timestamp"
EXPIRED_SCHEMA = "hash_prefix string, prompt_hash string, run_hash string, written_at timestamp"


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows dealt to ``tasks`` by key, evenly, each task in key order.

    With as many tasks as a store has buckets (its first session's shuffle partitions, the default), a
    task holds one bucket, and with fewer several whole ones, so an append has one file a bucket.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [k for k in KEYS if k in df.columns]
    dealt = df.repartition(parts, *keys)
    return (dealt if tasks is None or tasks >= parts else dealt.coalesce(tasks)).sortWithinPartitions(*keys)


def _of_run(df: DataFrame, run_hash: str | None) -> DataFrame:
    return df if run_hash is None else df.filter(F.col("run_hash") == run_hash)


_REGISTERED: dict[tuple[str, str], set[str]] = {}


class ResultStore:
    """Prompts, results and pending requests under one root folder."""

    SCHEMAS = {"results": RESULT_SCHEMA, "prompts": PROMPT_SCHEMA, "pending": PENDING_SCHEMA,
               "expired": EXPIRED_SCHEMA, "ledger": LEDGER_SCHEMA}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # --- tables -----------------------------------------------------------------

    def _keys(self, table: str) -> list[str]:
        return [k for k in KEYS if f"{k} string" in self.SCHEMAS[table]] if table != "ledger" else []

    def _batches(self, table: str) -> list[str]:
        """Names of the committed batches, by one call."""
        found = glob_paths(self.spark, f"{self.root}/{table}/batch=*/_SUCCESS")
        return sorted(p.rsplit("/", 2)[1].removeprefix("batch=") for p in found)

    def _buckets(self, batches: Sequence[str]) -> int:
        """The table's number of buckets, which stands in the names of its batches."""
        named = [m[1] for b in batches if (m := re.search(r"-n(\d+)-", b))]
        return int(named[0] if named else self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, table: str) -> DataFrame:
        batches = self._batches(table)
        schema, keys = self.SCHEMAS[table], self._keys(table)
        if not batches:
            return self.spark.createDataFrame([], schema)
        if not keys:
            return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/batch={b}" for b in batches])
        name = f"promptframe_{hashlib.md5(self.root.encode()).hexdigest()}_{table}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({schema}, batch string) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY ({', '.join(keys)}) INTO {self._buckets(batches)} BUCKETS LOCATION '{self.root}/{table}'")
        new = [b for b in batches if b not in self._known(name)]
        if new:
            parts = " ".join(f"PARTITION (batch = '{b}') LOCATION '{self.root}/{table}/batch={b}'" for b in new)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
            self._known(name).update(new)
        columns = self.spark.createDataFrame([], schema).columns
        return self.spark.table(name).filter(F.col("batch").isin(batches)).select(*columns)

    def batch(self, table: str, folder: str) -> DataFrame:
        """The rows of one append."""
        return self.spark.read.schema(self.SCHEMAS[table]).parquet(folder)

    def _known(self, name: str) -> set[str]:
        """The batches that this session's table has been told of."""
        return _REGISTERED.setdefault((self.spark.sparkContext.applicationId, name), set())

    def _append(self, table: str, df: DataFrame, at: datetime | None, once: str | None = None) -> str:
        """Write one batch, by the tasks that hold the rows; returns its folder.

        Of batches with the same ``once`` only the first is written.
        """
        number = uuid.uuid4().hex
        if once is not None:
            number = hashlib.md5(once.encode()).hexdigest()
            for done in glob_paths(self.spark, f"{self.root}/{table}/batch=*-{number}/_SUCCESS"):
                return f"{self.root}/{table}/{done.rsplit('/', 2)[1]}"
        end = number if once is not None else number[:8]
        at = at or datetime.now(timezone.utc)
        empty = self.spark.createDataFrame([], self.SCHEMAS[table])
        columns: list[Column] = []
        for f in empty.schema.fields:
            if f.name == "written_at":
                columns.append(F.lit(at).cast("timestamp").alias("written_at"))
            elif f.name == "prompt_ok":
                # checked once, where the text is at hand: lookups then read no text
                columns.append((F.sha1("prompt") == F.col("prompt_hash")).alias("prompt_ok"))
            elif f.name in df.columns:
                columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
            else:
                columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        keys = self._keys(table)
        stamp = at.strftime("%Y%m%d%H%M%S%f")
        if not keys:
            batch = f"{self.root}/{table}/batch={stamp}-{end}"
            df.select(*columns).write.parquet(batch)
            return batch
        buckets = self._buckets(self._batches(table))
        batch = f"{self.root}/{table}/batch={stamp}-n{buckets}-{end}"
        # the table of one batch is only the way to write buckets; its files stay
        name = f"promptframe_batch_{uuid.uuid4().hex}"
        df.select(*columns).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").option(
            "path", batch).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return batch

    def _live(self, records: DataFrame) -> DataFrame:
        """Records that no later expiry has killed."""
        if not self._batches("expired"):
            return records
        dead = self._read("expired").groupBy(*KEYS).agg(F.max("written_at").alias("_expired_at"))
        return (records.join(dead, KEYS, "left")
                .filter(F.col("_expired_at").isNull() | (F.col("written_at") > F.col("_expired_at")))
                .drop("_expired_at"))

    def results(self) -> DataFrame:
        """Live result records, older versions of a key included."""
        return self._live(self._read("results"))

    def _checked(self, run_hash: str | None) -> DataFrame:
        """Live records reduced to what a lookup needs, before anything is shuffled."""
        return self._live(lookup.checked(_of_run(self._read("results"), run_hash)))

    def prompts(self) -> DataFrame:
        return self._read("prompts")

    def pending(self) -> DataFrame:
        """State log of requests; an expired key is done."""
        if not self._batches("expired"):
            return self._read("pending")
        gone = self._read("expired").select(*KEYS, "written_at", F.lit("done").alias("state"))
        return self._read("pending").unionByName(gone, allowMissingColumns=True)

    def scan(self, pattern: str | None = None) -> DataFrame:
        """Stored records as (kind, prompt_hash, run_hash, name); ``pattern`` is a LIKE on name."""
        def listed(df: DataFrame, kind: str, run: Column, name: Column) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"), "prompt_hash", run.alias("run_hash"), name.alias("name"))

        none, result = F.lit(None).cast("string"), F.concat(F.lit("result_"), F.col("run_hash"), F.lit(".json"))
        out = listed(self.prompts(), "prompt", none, F.lit("prompt.txt"))
        out = out.unionByName(listed(self.results().select(*KEYS).distinct(), "result", F.col("run_hash"), result))
        waiting = lookup.pending_keys(self.pending())
        out = out.unionByName(listed(waiting, "pending", F.col("run_hash"),
                                     F.concat(result, F.lit(".delayed"))))
        return out if pattern is None else out.filter(F.col("name").like(pattern))

    # --- writes -----------------------------------------------------------------

    def write_prompts(self, grid: DataFrame, tasks: int | None = None, at: datetime | None = None) -> None:
        """Every distinct prompt that is not stored yet."""
        distinct = grid.select("hash_prefix", "prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
        fresh = distinct.join(self.prompts().select("hash_prefix", "prompt_hash"),
                              ["hash_prefix", "prompt_hash"], "left_anti")
        self._append("prompts", spread(fresh, tasks), at)

    def append(self, results: DataFrame, at: datetime | None = None, once: str | None = None) -> str:
        """Add records; partition them with :func:`spread` before a costly step, not after. Returns
        the folder of these records. A job that may run again names its records by ``once``."""
        return self._append("results", results, at, once)

    def append_ledger(self, entries: DataFrame) -> str:
        """Add money to the ledger of budgeted runs; returns the folder of these entries."""
        return self._append("ledger", entries.coalesce(1), None)

    def ledger(self, run_hash: str | None = None) -> DataFrame:
        """Money by run, by the wave whose answers cost it (-1: stored before), and by the wave of the
        combinations they serve."""
        return _of_run(self._read("ledger"), run_hash)

    def append_pending(self, rows: DataFrame, at: datetime | None = None, once: str | None = None) -> None:
        self._append("pending", rows, at, once)

    def submitted_stream(self) -> DataFrame:
        """Stream of the requests that are part of a batch, as their state rows are appended."""
        log = self.spark.readStream.schema(PENDING_SCHEMA).parquet(f"{self.root}/pending/batch=*")
        return log.filter(F.col("state") == "submitted")

    def not_expired(self, rows: DataFrame) -> DataFrame:
        """Rows (with key and ``written_at``) that no later expiry has killed."""
        return self._live(rows)

    # --- reads ------------------------------------------------------------------

    def latest(self, run_hash: str | None = None, fields: Sequence[Column | str] | None = None) -> DataFrame:
        """Newest live records; only these fields beside the key, if some are given."""
        rows = self._live(_of_run(self._read("results"), run_hash))
        return lookup.latest(rows if fields is None else rows.select(*KEYS, "written_at", *fields))

    def lookup(self, work: DataFrame, now: datetime | None = None, timeout: float | None = None,
               run_hash: str | None = None) -> DataFrame:
        """Status of the work; name the run if it is all of one, other runs are then left out."""
        pending = _of_run(self.pending(), run_hash)
        return lookup.lookup(work, self._checked(run_hash), pending, now, timeout)

    def misses(self, work: DataFrame, now: datetime | None = None, timeout: float | None = None,
               run_hash: str | None = None) -> DataFrame:
        pending = _of_run(self.pending(), run_hash)
        return lookup.misses(work, self._checked(run_hash), pending, now, timeout)

    def merge(self, other: "ResultStore | DataFrame", at: datetime | None = None) -> None:
        """Copy another store's newest records in; they win over records stored so far."""
        incoming = other.latest() if isinstance(other, ResultStore) else other
        self.append(spread(incoming), at)
        if isinstance(other, ResultStore):
            self.write_prompts(other.prompts(), at=at)

    def diff(self, other: "ResultStore") -> DataFrame:
        content = ["prompt", "response", "timestamp", "elapsed_time", "error"]
        return lookup.diff_counts(lookup.diff(self.latest(), other.latest(), content))

    def expire(self, now: datetime | None = None, older_than: float | None = None,
               errors_only: bool = False, keys: DataFrame | None = None, match: str = "all") -> int:
        """Expire newest records; returns how many there were."""
        at = now or datetime.now(timezone.utc)
        found = lookup.expired(self.latest(), at, older_than, errors_only, keys, match)
        return self.batch("expired", self._append("expired", found.select(*KEYS), at)).count()

    def statistics(self) -> DataFrame:
        def size(text: str) -> Column:
            return F.octet_length(text).alias(f"{text}_bytes")

        waiting = self.pending().join(lookup.pending_keys(self.pending()), KEYS, "left_semi")
        return lookup.statistics(
            self.prompts(), self.latest(fields=[size("response")]),
            lookup.latest(waiting.select(*KEYS, "written_at", size("body"))))

    def results_for(self, work: DataFrame) -> DataFrame:
        return lookup.results_for(work, self.results())

    def export(self, grid: DataFrame, work: DataFrame, root: str) -> DataFrame:
        """Copy what a project refers to into a new store; returns the missing keys."""
        target = ResultStore(self.spark, root)
        target.append(spread(lookup.export(work, self.latest())))
        stored = self.prompts().join(grid.select("hash_prefix", "prompt_hash").distinct(),
                                     ["hash_prefix", "prompt_hash"], "left_semi")
        target.write_prompts(stored)
        return lookup.missing(work, self.latest())


def import_cache_dir(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records of a file tree ``cache/<xx>/<key>/{prompt.txt, result_<run>.json[.delayed]}``:
    prompts, results and pending rows. Unreadable results are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.col("content").cast("string")
    placed = files.select(
        F.element_at(F.split("path", "/"), -2).alias("prompt_hash"), name.alias("name"),
        F.col("modificationTime").alias("written_at"), text.alias("text")
    ).withColumn("hash_prefix", F.substring("prompt_hash", 1, 2))
    prompts = placed.filter("name = 'prompt.txt'").select(
        "hash_prefix", "prompt_hash", F.col("text").alias("prompt"), "written_at")

    def number(field: str, usage: str, dtype: str) -> Column:
        return F.get_json_object("text", f"$.usage['{usage}']").cast(dtype).alias(field)

    usage = F.struct(
        number("tokens_in", "tokens in", "bigint"), number("tokens_out", "tokens out", "bigint"),
        number("bytes_in", "bytes in", "bigint"), number("bytes_out", "bytes out", "bigint"),
        number("cost_in", "cost in", "double"), number("cost_out", "cost out", "double"),
        number("discount", "discount", "double"), number("cost", "cost", "double"))
    shared = [
        "hash_prefix", "prompt_hash", F.regexp_extract("name", r"^result_(.*?)\.json", 1).alias("run_hash"),
        F.get_json_object("text", "$.prompt").alias("prompt"),
        F.get_json_object("text", "$.module_name").alias("module_name"),
        F.get_json_object("text", "$.module_version").alias("module_version"),
        F.get_json_object("text", "$.module_args").alias("module_args_json"),
        F.get_json_object("text", "$.timestamp").alias("timestamp"), "written_at",
        F.from_json(F.get_json_object("text", "$.params"), "map<string,string>").alias("params")]
    readable = F.try_parse_json("text").isNotNull()
    results = placed.filter(F.col("name").rlike(r"^result_.*\.json$") & readable).select(
        *shared, F.get_json_object("text", "$.response").alias("response"), usage.alias("usage"),
        F.get_json_object("text", "$.elapsed_time").cast("double").alias("elapsed_time"),
        F.get_json_object("text", "$.batch_id").alias("batch_id"),
        F.get_json_object("text", "$.error").alias("error"))
    pending = placed.filter(F.col("name").rlike(r"^result_.*\.json\.delayed$") & readable).select(
        *shared, F.get_json_object("text", "$.delayed.body").alias("body"),
        F.get_json_object("text", "$.delayed.batch_id").alias("batch_id")
    ).withColumn("state", F.when(F.col("batch_id").isNotNull(), "submitted").otherwise("queued"))
    return prompts, results, pending
