"""Arriving files: events, keys, validation, quarantine, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tachado import constants as K
from tachado.functions.text import as_col, cut
from tachado.schemas import FILE_EVENT


def decode_key(x) -> Column:
    """URL-decode a key, ``+`` as a blank; an undecodable key stays as it is but for ``+``."""
    return F.coalesce(F.try_url_decode(as_col(x)), F.replace(as_col(x), F.lit("+"), F.lit(" ")))


def parse_file_events(events: DataFrame, json_col: str = "event") -> DataFrame:
    """Bucket, key and size of an event's first record, and why it cannot be used."""
    records = F.from_json(json_col, FILE_EVENT)["Records"]
    s3 = F.get(records, F.lit(0))["s3"]
    key = decode_key(s3["object"]["key"])
    bucket = s3["bucket"]["name"]
    error = (F.when(records.isNull() | (F.size(records) == 0), "no_records")
             .when(F.coalesce(bucket, F.lit("")) == "", "no_bucket")
             .when(F.coalesce(key, F.lit("")) == "", "no_key"))
    return (events.withColumn("bucket", bucket).withColumn("key", key)
            .withColumn("size", F.coalesce(s3["object"]["size"], F.lit(0).cast("bigint"))).withColumn("error_reason", error))


def split_object_key(files: DataFrame, key="key", root: str = K.ROOT_ORIGINALS) -> DataFrame:
    """``originales/{user}/{name}`` -> user_id, file_name, document_id, or an error_reason (S3)."""
    k = as_col(key)
    parts = F.split(k, "/", 3)
    user, name = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    error = (F.when(k.isNull() | ~k.startswith(f"{root}/"), "wrong_prefix")
             .when(F.size(parts) < 3, "wrong_pattern").when(user == "", "no_user").when(name == "", "no_file"))
    ok = error.isNull()
    return (files.withColumn("user_id", F.when(ok, user)).withColumn("file_name", F.when(ok, name))
            .withColumn("document_id", F.when(ok, name)).withColumn("error_reason", error))


def size_reason(length, max_bytes: int = K.MAX_FILE_BYTES) -> Column:
    """Why a file is too large, null if it is not (B1)."""
    n = as_col(length)
    megabytes = F.bround(n / 1048576, 1).cast("decimal(20,1)").cast("string")
    return F.when(n >= max_bytes, F.concat(F.lit("too_large: "), megabytes,
                                           F.lit(f"MB (max {max_bytes // 1048576}MB)")))


def header_reason(content) -> Column:
    """Why the first bytes are not a PDF's, null if they are (B2)."""
    head = F.coalesce(F.hex(F.substring(as_col(content).cast("binary"), 1, 4)), F.lit(""))
    return F.when(head != "25504446", "no_pdf_header")


def validate_files(files: DataFrame) -> DataFrame:
    """Files with the first check they fail, size before header.

    ``content`` may be absent (metadata only: size is the only check).  Where the
    files are on storage, ``sources.files.validate_folder`` drops oversized ones by
    their length before any content is read.
    """
    reasons = [size_reason("length")] + ([header_reason("content")] if "content" in files.columns else [])
    return files.withColumn("error_reason", F.coalesce(*reasons) if len(reasons) > 1 else reasons[0])


def route_invalid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid files, quarantine rows) of validated files with their key parts."""
    bad = validated.filter("error_reason is not null").select(
        F.concat_ws("/", F.lit(K.ROOT_ERRORS), "user_id", "document_id", "file_name").alias("error_key"),
        cut("error_reason", 1024).alias("error_reason"), F.current_timestamp().alias("error_timestamp"),
        F.col("file_name").alias("original_filename"), F.col("key").alias("original_key"), "user_id", "document_id")
    return validated.filter("error_reason is null").drop("error_reason"), bad


def validate_upload(batch: DataFrame, max_files: int = K.MAX_UPLOAD_FILES,
                    max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """Each file of an upload request with the reason it is refused.

    ``batch`` has batch_id, file_name and file_size.  The count of a batch is an
    aggregate joined back, so one huge batch is never gathered in a task; a request
    without files has no rows and is refused by whoever counts zero.
    """
    counts = batch.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_files"))
    name = F.coalesce("file_name", F.lit(""))
    reason = (F.when(F.col("_files") > max_files, "too_many_files").when(name == "", "no_name")
              .when(~F.lower(name).endswith(".pdf"), "not_a_pdf")
              .when(F.coalesce("file_size", F.lit(0)) > max_bytes, "too_large"))
    return batch.join(counts, "batch_id").withColumn("error_reason", reason).drop("_files")


def scope_prefix(prefix, user) -> Column:
    """The prefix a user may list: their own folder, null for somebody else's."""
    p, u = F.regexp_replace(as_col(prefix), r"\A/+", ""), as_col(user)
    root, owner = F.substring_index(p, "/", 1), F.get(F.split(p, "/", 3), F.lit(1))
    known = p.contains("/") & root.isin(K.USER_ROOTS)
    return (F.when(~known, F.concat(F.lit(f"{K.ROOT_ORIGINALS}/"), u, F.lit("/")))
            .when(p == F.concat(root, F.lit("/")), F.concat(p, u, F.lit("/")))
            .when(owner == u, p))


def owned_key(key, user, root: str | None = None) -> Column:
    """May the user touch this key: non-empty, no ``..``, and the user's own folder.

    The owner is the path segment after the root, not any substring of the key.
    """
    k, u = as_col(key), as_col(user)
    own = F.coalesce(F.get(F.split(k, "/"), F.lit(1)) == u, F.lit(False))
    at_root = k.startswith(f"{root}/") if root else F.lit(True)
    return F.coalesce((k != "") & ~k.contains("..") & own & at_root, F.lit(False))


def plan_reprocess(keys: DataFrame, files: DataFrame, user) -> DataFrame:
    """Requested keys with their size if they can be queued, else the reason not."""
    u = F.lit(user) if isinstance(user, str) else user
    listed = files.select("key", F.col("size").alias("size"), F.lit(True).alias("_there"))
    k = F.coalesce("key", F.lit(""))
    reason = (F.when(~k.startswith(f"{K.ROOT_ORIGINALS}/"), "not_an_original")
              .when(~owned_key("key", u, K.ROOT_ORIGINALS), "not_owned")
              .when(F.col("_there").isNull(), "no_longer_exists"))
    return (keys.join(listed, "key", "left").withColumn("reason", reason)
            .withColumn("queued", F.col("reason").isNull()).drop("_there"))


def name_contains(files: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Files whose name contains the text, ignoring case."""
    return files.filter(F.contains(F.lower(name), F.lower(F.lit(query))))


def name_endswith(files: DataFrame, suffix: str, name: str = "name") -> DataFrame:
    """Files of a kind, by the end of their name."""
    return files.filter(F.lower(name).endswith(suffix.lower()))


def downloadable(status: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Finished documents whose output of that kind exists."""
    keys = {"pdf": "key_masked", "markdown": "key_report"}
    if kind not in keys:
        raise ValueError(f"unknown download kind: {kind}")
    done = status.filter(F.col("status") == "COMPLETED").withColumn("key", F.nullif(F.col(keys[kind]), F.lit("")))
    return done.filter("key is not null").join(files.select("key").distinct(), "key", "left_semi")
