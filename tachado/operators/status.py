"""Document status: events to current rows, listings, progress, purges."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tachado import constants as K
from tachado.functions.display import doc_state, masked_state
from tachado.functions.text import as_col
from tachado.sources import buckets

KEYS = ["user_id", "document_id"]
ATTRIBUTES = [
    "file_name", "file_size", "key_original", "key_masked", "key_report", "status", "error_message", "error_step",
    "entities_found", "entities_by_type", "processing_ms", "uploaded_at", "completed_at", "engine", "scan_status",
    "index_key",
]
_EVENT = ["ts", "seq", "op"]


def index_key(status, ts) -> Column:
    """``STATUS#s#TIMESTAMP#t``, the order of the stored index."""
    stamp = F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.lit("STATUS#"), as_col(status), F.lit("#TIMESTAMP#"), stamp)


def latest_status(events: DataFrame, keys=KEYS) -> DataFrame:
    """Current row per document from put and update events.

    A put replaces the row, an update overlays the attributes it carries.  So an
    attribute is what the last event that could set it said: any put, or an update
    that carries it.  That is one partially aggregated maximum per attribute: no
    window, no join, and a user with most of the events is combined map-side.
    """
    when = F.struct("ts", "seq")
    attributes = [c for c in events.columns if c not in [*keys, *_EVENT]]

    def last(name):
        # filter by nulling the order: a null order never wins
        says = (F.col("op") == "put") | F.col(name).isNotNull()
        return F.max_by(F.struct(F.col(name).alias("v")), F.when(says, when))["v"].alias(name)

    return events.groupBy(*keys).agg(*[last(a) for a in attributes], F.max("ts").alias("last_ts"))


apply_status_events = latest_status


def said(events: DataFrame, keys=KEYS) -> DataFrame:
    """Current rows with, in place of each attribute, its value and the event that said it: (v, ts, seq), null if none did.

    Such rows of any parts of the events, in any order, add up by ``merged``, also where an event comes late.
    """
    when = F.struct("ts", "seq")
    attributes = [c for c in events.columns if c not in [*keys, *_EVENT]]

    def last(name):
        says = (F.col("op") == "put") | F.col(name).isNotNull()
        return F.max_by(F.struct(F.col(name).alias("v"), "ts", "seq"), F.when(says, when)).alias(name)

    return events.groupBy(*keys).agg(*[last(a) for a in attributes], F.max("ts").alias("last_ts"))


def merged(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of ``said`` of the same documents made one."""
    attributes = [c for c in rows.columns if c not in [*keys, "last_ts"]]

    def later(name):
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(F.col(f"{name}.ts"), F.col(f"{name}.seq")))).alias(name)

    return rows.groupBy(*keys).agg(*[later(a) for a in attributes], F.max("last_ts").alias("last_ts")).select(rows.columns)


def current(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Rows of ``said`` as ``latest_status`` gives them."""
    return rows.select(*[F.col(c) if c in [*keys, "last_ts"] else F.col(f"{c}.v").alias(c) for c in rows.columns])


def put_status(events: DataFrame, path: str, batch: int | None = None, keys=KEYS, buckets_of: int = buckets.BUCKETS) -> int:
    """Bring the stored status table up to date with events, also late ones (S10); only touched buckets are written.

    A stored attribute keeps the time of the event that said it, so events may come in any order.  ``batch`` numbers
    micro-batches: one that was taken already changes nothing.
    """
    return buckets.upsert(said(events, keys), path, list(keys), lambda rows: merged(rows, keys), buckets_of, batch)


def stored_status(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    """The rows of the stored status table."""
    return current(buckets.read(spark, path), keys)


def fold_stored(stored: DataFrame, events: DataFrame, keys=KEYS) -> DataFrame:
    """A status table in memory brought up to date with newer events: its rows count as puts."""
    attributes = [c for c in stored.columns if c not in [*keys, "last_ts"]]
    base = stored.select(*keys, F.col("last_ts").alias("ts"), F.lit(-1).cast("bigint").alias("seq"),
                         F.lit("put").alias("op"), *attributes)
    return latest_status(base.unionByName(events, allowMissingColumns=True), keys)


def track(requested: DataFrame, status: DataFrame) -> DataFrame:
    """Requested documents with their current state; without one they keep what they had.

    ``requested`` has the keys and ``previous`` (the last known state).
    """
    current = status.select(*KEYS, doc_state("status").alias("_state"),
                            masked_state("status", "key_masked", "entities_found").alias("_masked"), "entities_found")
    return requested.join(current, KEYS, "left").select(
        *requested.columns, F.coalesce("_state", "previous").alias("state"), F.col("_masked").alias("masked_state"),
        F.col("entities_found"), F.col("_state").isNotNull().alias("known"))


# ---------------------------------------------------------------- listings

def list_documents(status: DataFrame, user, limit: int = K.LIST_LIMIT, order: str = "uploaded") -> DataFrame:
    """A user's documents, newest upload first.

    ``order="index"`` sorts by the stored index instead: status name, then time.
    """
    by = {"uploaded": "uploaded_at", "index": "index_key"}[order]
    return (status.filter(F.col("user_id") == user).orderBy(F.col(by).desc_nulls_last(), F.col("document_id").desc())
            .limit(int(limit)))


def page_token(row, order_by: str = "uploaded_at", key: str = "document_id") -> str:
    """Opaque token of the last row of a page."""
    last = row[order_by]
    last = last.isoformat() if isinstance(last, datetime) else last
    return base64.b64encode(json.dumps({"last": last, "key": row[key]}).encode()).decode()


def next_page(df: DataFrame, token: str | None, limit: int = K.LIST_LIMIT, order_by: str = "uploaded_at",
              key: str = "document_id") -> DataFrame:
    """The rows after a token, newest first (T2); a malformed token is refused."""
    if token:
        try:
            at = json.loads(base64.b64decode(token, validate=True))
            last, last_key = at["last"], at["key"]
        except (ValueError, KeyError, TypeError) as error:
            raise ValueError("malformed page token") from error
        bound = F.lit(last).cast(df.schema[order_by].dataType)
        k = F.lit(last_key).cast(df.schema[key].dataType)
        df = df.filter((F.col(order_by) < bound) | ((F.col(order_by) == bound) & (F.col(key) < k)))
    return df.orderBy(F.col(order_by).desc(), F.col(key).desc()).limit(int(limit))


def page_of(df: DataFrame, n: int, size: int = K.PAGE_SIZE) -> DataFrame:
    """Page ``n`` (from 1) of an ordered frame."""
    return df.offset((n - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = K.PAGE_SIZE) -> DataFrame:
    """Rows and pages of a frame."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.ceil(n / size).cast("bigint").alias("pages"))


def sort_by(df: DataFrame, column: str, desc: bool = False, tie: str | None = None) -> DataFrame:
    """Sort by a chosen column (T4)."""
    c = F.col(column)
    order = [c.desc() if desc else c.asc()] + ([F.col(tie)] if tie else [])
    return df.orderBy(*order)


def get_document(status: DataFrame, user, document) -> DataFrame:
    """One document of one user; no row whether it does not exist or is not theirs."""
    return status.filter((F.col("user_id") == user) & (F.col("document_id") == document))


# ---------------------------------------------------------------- counts

def progress(tracked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Finished, total and rounded percentage of tracked documents (A4)."""
    done = F.count_if(F.col("state").isin("COMPLETED", "FAILED"))
    total = F.count(F.lit(1))
    percent = F.when(total > 0, F.floor(done * 100.0 / F.nullif(total, F.lit(0)) + 0.5)).otherwise(0)
    grouped = tracked.groupBy(*keys) if keys else tracked
    return grouped.agg(done.alias("finished"), total.alias("total"), percent.cast("bigint").alias("percent"))


def all_terminal(tracked: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Has every tracked document finished; one without a status has not (A5)."""
    done = F.col("known") & F.col("state").isin("COMPLETED", "FAILED")
    grouped = tracked.groupBy(*keys) if keys else tracked
    return grouped.agg(F.coalesce(F.bool_and(done), F.lit(True)).alias("all_terminal"))


def batch_outcome(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Successes, failures and how many different reasons there are (A6); see ``failure_reasons``."""
    grouped = results.groupBy(*keys) if keys else results
    return grouped.agg(F.count_if(F.col("reason").isNull()).alias("successes"),
                       F.count_if(F.col("reason").isNotNull()).alias("failures"),
                       F.count_distinct("reason").alias("reasons"))


def failure_reasons(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The different reasons, as rows."""
    return results.filter("reason is not null").select(*(keys or []), "reason").distinct()


# ---------------------------------------------------------------- purges and retention

PURGE_SCOPES = {
    "obfuscated": [K.ROOT_PROCESSING, K.ROOT_MASKED],
    "originals": [K.ROOT_ORIGINALS],
    "all": [K.ROOT_PROCESSING, K.ROOT_MASKED, K.ROOT_ORIGINALS],
}


def _purged_folder(key, user, scope: str) -> Column:
    if scope not in PURGE_SCOPES:
        raise ValueError(f"unknown purge scope: {scope}")
    u = F.lit(user) if isinstance(user, (str, int)) else user
    out = F
    for root in PURGE_SCOPES[scope]:
        out = out.when(F.startswith(as_col(key), F.concat(F.lit(f"{root}/"), u.cast("string"), F.lit("/"))), root)
    return out


def purge(files: DataFrame, user, scope: str = "obfuscated") -> tuple[DataFrame, DataFrame]:
    """(files that stay, files that go) when a user empties folders."""
    marked = files.withColumn("folder", _purged_folder("key", user, scope))
    return marked.filter("folder is null").drop("folder"), marked.filter("folder is not null")


def purge_counts(files: DataFrame, user, scope: str = "obfuscated") -> DataFrame:
    """How many files of each folder go."""
    return purge(files, user, scope)[1].groupBy("folder").agg(F.count(F.lit(1)).alias("deleted"))


def purge_audit(status: DataFrame, user) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, count of deleted) when a user clears their audit; files are untouched (U4)."""
    mine = F.col("user_id") == user
    return status.filter(~mine), status.filter(mine).agg(F.count(F.lit(1)).alias("deleted"))


def delete_document(status: DataFrame, files: DataFrame, user, document) -> tuple[DataFrame, DataFrame]:
    """(status rows, files) that stay when one document goes with its three objects (U4)."""
    gone = get_document(status, user, document)
    keys = gone.select(F.explode(F.array("key_original", "key_masked", "key_report")).alias("key")).filter("coalesce(key, '') <> ''")
    stay = status.filter(~((F.col("user_id") == user) & (F.col("document_id") == document)))
    return stay, files.join(keys, "key", "left_anti")


def apply_retention(files: DataFrame, now, policy: dict[str, int] | None = None) -> DataFrame:
    """Files younger than their folder's retention; folders without one keep everything."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    days = F
    for prefix, n in (policy or K.RETENTION_DAYS).items():
        days = days.when(F.col("key").startswith(prefix), n)
    kept = files.withColumn("_days", days)
    # A day is 24 hours, whatever the session's zone does with its clocks.
    age = F.unix_micros(at) - F.unix_micros(F.col("modified").cast("timestamp"))
    return kept.filter(F.col("_days").isNull() | (age <= F.col("_days").cast("bigint") * F.lit(86400000000))).drop("_days")
