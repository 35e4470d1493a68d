"""Joins of work with stored results. Keys are ``hash_prefix, prompt_hash, run_hash``.

Validity is decided on thin rows (key and times): the text check compares the digest
of the stored prompt with its key at the scan, so no text enters a shuffle, and only
primitive maxima are aggregated, which collapses frequent keys before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from promptframe.functions.answers import has_error

KEYS = ["hash_prefix", "prompt_hash", "run_hash"]


def checked(results: DataFrame) -> DataFrame:
    """Key, time and whether the stored prompt is the one its key was made from: as the store
    found when it was written (``prompt_ok``), else by the text."""
    unchanged = F.col("prompt_ok") if "prompt_ok" in results.columns else F.sha1("prompt") == F.col("prompt_hash")
    return results.select(*KEYS, "written_at", unchanged.alias("unchanged"))


def valid_keys(results: DataFrame, now: Column | datetime, timeout: float | None = None) -> DataFrame:
    """Keys whose newest record is unchanged and younger than ``timeout`` seconds.

    Takes records, or their :func:`checked` form.
    """
    thin = results if "unchanged" in results.columns else checked(results)
    newest = thin.groupBy(*KEYS).agg(
        F.max("written_at").alias("_last"),
        F.max(F.when(F.col("unchanged"), F.col("written_at"))).alias("_last_good"))
    fresh = F.col("_last") == F.col("_last_good")
    if timeout is not None:
        age = _seconds(_as_column(now)) - _seconds(F.col("_last"))
        fresh = fresh & (age < F.lit(float(timeout)))
    return newest.filter(fresh).select(*KEYS, F.col("_last").alias("written_at"))


def pending_keys(pending: DataFrame) -> DataFrame:
    """Keys whose newest state is not ``done``."""
    newest = pending.groupBy(*KEYS).agg(
        F.max("written_at").alias("_last"),
        F.max(F.when(F.col("state") == "done", F.col("written_at"))).alias("_done"))
    return newest.filter(F.col("_done").isNull() | (F.col("_last") > F.col("_done"))).select(*KEYS)


def lookup(work: DataFrame, results: DataFrame, pending: DataFrame | None = None,
           now: Column | datetime | None = None, timeout: float | None = None) -> DataFrame:
    """``work`` plus ``status``: cached, pending or missing."""
    # two joins, not one with a union, which would hide how either side is stored
    known = valid_keys(results, now, timeout).select(*KEYS, F.lit("cached").alias("_state"))
    found = work.join(known, KEYS, "left")
    status = F.coalesce("_state", F.lit("missing"))
    if pending is not None:
        # a pending key is not a hit, whatever is stored
        found = found.join(pending_keys(pending).select(*KEYS, F.lit("pending").alias("_waiting")), KEYS, "left")
        status = F.coalesce("_waiting", status)
    return found.withColumn("status", status).drop("_state", "_waiting")


def misses(work: DataFrame, results: DataFrame, pending: DataFrame | None = None,
           now: Column | datetime | None = None, timeout: float | None = None) -> DataFrame:
    """Work that must be executed: neither answered nor waiting."""
    out = work.join(valid_keys(results, now, timeout).select(*KEYS), KEYS, "left_anti")
    return out if pending is None else out.join(pending_keys(pending), KEYS, "left_anti")


def latest(results: DataFrame, by: Sequence[str] = KEYS, at: str = "written_at") -> DataFrame:
    """The newest record of each key, whole."""
    rest = [c for c in results.columns if c not in by]
    order = F.struct(at, *[c for c in ("response",) if c in rest])
    newest = results.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return newest.select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in results.columns])


def merge(mine: DataFrame, other: DataFrame, by: Sequence[str] = KEYS, at: str = "written_at") -> DataFrame:
    """Both stores as one; for a key in both the incoming record wins."""
    both = mine.withColumn("_from", F.lit(0)).unionByName(other.withColumn("_from", F.lit(1)))
    rest = [c for c in mine.columns if c not in by]
    newest = both.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("_from", at)).alias("_r"))
    return newest.select(*[F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in mine.columns])


def diff(mine: DataFrame, other: DataFrame, content: Sequence[str], by: Sequence[str] = KEYS) -> DataFrame:
    """Per incoming key: ``copied`` (new), ``equal`` or ``different``.

    Both sides are reduced to key and content digest before the join.
    """
    def thin(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.sha1(F.to_json(F.struct(*content), {"ignoreNullFields": "false"})).alias(name))

    joined = thin(other, "_theirs").join(thin(mine, "_mine"), list(by), "left")
    status = (F.when(F.col("_mine").isNull(), "copied")
              .when(F.col("_mine") == F.col("_theirs"), "equal").otherwise("different"))
    return joined.select(*by, status.alias("status"))


def diff_counts(differences: DataFrame) -> DataFrame:
    return differences.agg(*[
        F.count_if(F.col("status") == s).alias(s) for s in ("copied", "equal", "different")])


def expired(results: DataFrame, now: Column | datetime, older_than: float | None = None,
            errors_only: bool = False, keys: DataFrame | None = None, match: str = "all") -> DataFrame:
    """Records to expire: at least ``older_than`` seconds old, with an unreadable answer,
    of the given keys. ``match="any"`` takes age or error."""
    tests = []
    if older_than is not None:
        age = _seconds(_as_column(now)) - _seconds(F.col("written_at"))
        tests.append(age >= F.lit(float(older_than)))
    if errors_only:
        tests.append(has_error(F.col("response")))
    found = results
    if tests:
        test = tests[0]
        for other in tests[1:]:
            test = (test | other) if match == "any" else (test & other)
        found = found.filter(test)
    elif match == "any":
        found = found.filter(F.lit(False))
    if keys is not None:
        found = found.join(keys.select(*KEYS).distinct(), KEYS, "left_semi")
    return found


def statistics(prompts: DataFrame, results: DataFrame, pending: DataFrame) -> DataFrame:
    """Records and bytes of a store, by kind; texts may be given by their ``_bytes``."""
    def part(df: DataFrame, text: str, kind: str) -> DataFrame:
        size = F.col(f"{text}_bytes") if f"{text}_bytes" in df.columns else F.octet_length(text)
        return df.agg(F.count(F.lit(1)).alias("n"),
                      F.coalesce(F.sum(size), F.lit(0)).alias("b")
                      ).select(F.lit(kind).alias("kind"), "n", "b")

    parts = (part(prompts, "prompt", "prompt").unionByName(part(results, "response", "result"))
             .unionByName(part(pending, "body", "delayed")))

    def n(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))

    return parts.agg(
        F.sum("n").alias("total_files"),
        F.sum("b").alias("total_size_bytes"),
        F.round(F.sum("b") / (1024 * 1024), 2).alias("total_size_mb"),
        n("prompt").alias("prompt_files_count"),
        n("result").alias("result_files_count"),
        n("delayed").alias("delayed_files_count"))


def results_for(work: DataFrame, results: DataFrame) -> DataFrame:
    """Every combination and run with its newest answer, or a note that there is none."""
    answers = latest(results.select(*KEYS, "response", "written_at")).select(*KEYS, "response")
    return work.join(answers, KEYS, "left").withColumn(
        "content", F.coalesce("response", F.lit("No result found"))).drop("response")


def side_by_side(found: DataFrame) -> DataFrame:
    """One text per combination with the answers of all runs, in run order; NULL when no
    run has an answer. A combination has one row per run."""
    rule = "=" * 80
    block = F.concat(
        F.lit(f"{rule}\nRun: "), F.col("run_name"), F.lit(f"\n{rule}\n"), F.col("content"), F.lit("\n" * 4))
    any_answer = F.bool_or(F.col("content") != "No result found")
    return found.groupBy("combo_id").agg(
        any_answer.alias("_any"),
        F.array_sort(F.collect_list(F.struct("run_ord", block.alias("block")))).alias("_blocks")
    ).select("combo_id", F.when(F.col("_any"), F.array_join("_blocks.block", "")).alias("text"))


def export(work: DataFrame, results: DataFrame) -> DataFrame:
    """Stored records that the work refers to."""
    return results.join(work.select(*KEYS).distinct(), KEYS, "left_semi")


def missing(work: DataFrame, results: DataFrame) -> DataFrame:
    """Keys of the work without a stored record."""
    return work.select(*KEYS).distinct().join(results.select(*KEYS).distinct(), KEYS, "left_anti")


def _as_column(now: Column | datetime | None) -> Column:
    if now is None:
        return F.current_timestamp()
    return now if isinstance(now, Column) else F.lit(now)


def _seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000.0)
