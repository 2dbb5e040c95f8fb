"""The given tables in the roles the operators expect.

Every role is a projection, an explode or an aggregate of a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tachado import constants as K
from tachado.operators.detect import default_rules
from tachado.sources.files import read_table

LINES_PER_PAGE = 20
ALL_RULES = [dict(r, enabled=True) for r in default_rules()]
PHONES = ["TELEFONO", "CELULAR", "TELEFONO_CHILE"]


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as one-page documents; the source is the user."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "source", spread=True)
    return docs.select("doc_id", F.lit(1).alias("page"), "text", F.col("source").alias("user_id"))


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of ``documents``: doc_id, line, page, text."""
    docs = read_table(spark, d, "documents", "doc_id", "text", spread=True)
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn(
        "page", (F.floor(F.col("line") / LINES_PER_PAGE) + 1).cast("int"))


def split_pages(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` cut into pages of twenty lines, inside the row."""
    docs = read_table(spark, d, "documents", "doc_id", "text", "source", spread=True)
    lines = F.split("text", "\n", -1)
    n = F.ceil(F.size("l") / LINES_PER_PAGE).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.array_join(
        F.slice("l", p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n"))
    return (docs.withColumn("l", lines).select("doc_id", F.col("source").alias("user_id"), F.posexplode(pages).alias("p", "text"))
            .select("doc_id", (F.col("p") + 1).alias("page"), "text", "user_id"))


def conversation_pages(spark: SparkSession, d: str) -> DataFrame:
    """``conversations`` as documents with a page per turn."""
    c = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text", spread=True)
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text",
                    F.col("role").alias("user_id"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Recognised blocks: a LINE per line of ``documents`` out of place, its words, and the line's page."""
    lines = doc_lines(spark, d).withColumn("words", F.filter(F.split("text", " ", -1), lambda w: w != ""))
    top = (F.col("line") * 7 % LINES_PER_PAGE) / F.lit(float(LINES_PER_PAGE))
    left = (F.col("line") * 3 % 5) / F.lit(5.0)
    line_id = F.concat(F.lit("L"), F.col("line").cast("string"))
    ids = F.transform("words", lambda w, i: F.concat(line_id, F.lit("W"), i.cast("string")))
    rel = F.array(F.struct(F.lit("CHILD").alias("type"), F.concat(ids, F.array(F.lit("gone"))).alias("ids")),
                  F.struct(F.lit("VALUE").alias("type"), F.slice(ids, 1, 1).alias("ids")))
    types = "array<struct<type:string,ids:array<string>>>"
    line_rows = lines.select("doc_id", line_id.alias("id"), F.lit("LINE").alias("block_type"), "page", "text",
                             left.alias("left"), top.alias("top"), F.lit(0.5).alias("width"), F.lit(0.04).alias("height"),
                             rel.cast(types).alias("relationships"), F.col("line").alias("ord"))
    words = lines.select("doc_id", "line", "page", line_id.alias("line_id"), F.posexplode("words").alias("i", "text"))
    word_rows = words.select(
        "doc_id", F.concat("line_id", F.lit("W"), F.col("i").cast("string")).alias("id"), F.lit("WORD").alias("block_type"),
        "page", "text", ((F.col("line") * 3 % 5) / 5.0 + F.col("i") / 100.0).alias("left"),
        ((F.col("line") * 7 % LINES_PER_PAGE) / F.lit(float(LINES_PER_PAGE))).alias("top"),
        F.lit(0.01).alias("width"), F.lit(0.04).alias("height"), F.lit(None).cast(types).alias("relationships"),
        F.col("line").alias("ord"))
    return line_rows.unionByName(word_rows)


def page_words() -> Column:
    """The words of a page, in its row."""
    return F.array_remove(F.split("text", r"\s+", -1), "")


def laid_word(word: Column, at: Column) -> Column:
    """A word and its place in a made-up layout: eight words a line, six units a character."""
    place, line = at % 8, F.floor(at / 8)
    return F.struct(
        at.alias("word_ord"), word.alias("text"), (place * 60.0).alias("x0"), (line * 12.0).alias("y0"),
        (place * 60.0 + F.least(F.length(word), F.lit(9)) * 6.0).alias("x1"), (line * 12.0 + 10.0).alias("y1"),
        F.lit(0).alias("block"), line.cast("int").alias("line"))


def words(pages: DataFrame) -> DataFrame:
    """Words of pages with their layout."""
    rows = pages.select("doc_id", "page", F.posexplode(page_words()).alias("word_ord", "text"))
    return rows.select("doc_id", "page", laid_word(F.col("text"), F.col("word_ord")).alias("w")).select("doc_id", "page", "w.*")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Stored files from ``documents``: the language decides the folder, the source is the owner."""
    docs = read_table(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    root = (F.when(F.col("lang") == "en", K.ROOT_ORIGINALS).when(F.col("lang") == "fr", K.ROOT_MASKED)
            .when(F.col("lang") == "de", K.ROOT_PROCESSING).otherwise(K.ROOT_ERRORS))
    ending = F.when(F.col("n_chars") % 3 == 0, ".md").otherwise(".pdf")
    name = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"), ending)
    return docs.select(
        F.concat_ws("/", root, "source", name).alias("key"), name.alias("name"), (F.col("n_chars") * 65536).alias("size"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(n_chars AS INT))").alias("modified"),
        F.col("source").alias("user_id"), "doc_id")


def status_events(spark: SparkSession, d: str) -> DataFrame:
    """Status events from ``events``: puts, completions, failures and an engine note, about ten documents a user."""
    return as_status_events(read_table(spark, d, "events"))


def as_status_events(e: DataFrame) -> DataFrame:
    doc = F.concat(F.lit("doc-"), F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("string"))
    user = F.col("user_id").cast("string")
    e = e.select(F.col("user_id"), doc.alias("document_id"), "ts", F.col("event_id").alias("seq"), "event_type", "value")
    kind = F.col("event_type")
    put, done, failed = kind.isin("signup", "view"), kind == "purchase", kind == "error"
    stem = F.concat(F.lit("ofuscados/"), user, F.lit("/"), F.col("document_id"))
    status = F.when(kind == "signup", "UPLOADED").when(kind == "view", "PROCESSING").when(done, "COMPLETED").when(failed, "FAILED")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(
        "user_id", "document_id", "ts", "seq", F.when(put, "put").otherwise("update").alias("op"),
        F.when(put, F.concat("document_id", F.lit(".pdf"))).alias("file_name"),
        F.when(put, F.floor(F.col("value") * 100)).cast("bigint").alias("file_size"),
        F.when(put, F.concat(F.lit("originales/"), user, F.lit("/"), F.col("document_id"), F.lit(".pdf"))).alias("key_original"),
        F.when(done & (F.col("value") >= 5), F.concat(stem, F.lit("_ofuscado.pdf"))).when(done, "").alias("key_masked"),
        F.when(done & (F.col("value") >= 5), F.concat(stem, F.lit("_informe.md"))).when(done, "").alias("key_report"),
        status.alias("status"),
        F.when(failed, F.lit("could not mask")).alias("error_message"), F.when(failed, F.lit("REDACTION")).alias("error_step"),
        F.when(done, F.floor("value")).cast("bigint").alias("entities_found"),
        F.when(done | failed, F.floor(F.col("value") * 1000)).cast("bigint").alias("processing_ms"),
        F.when(put, F.col("ts")).alias("uploaded_at"), F.when(done | failed, F.col("ts")).alias("completed_at"),
        F.when(kind == "click", "Regex").when(done, "IA + Regex").alias("engine"),
        F.when(done, "DISABLED").alias("scan_status"),
        F.when(put | failed, F.concat(F.lit("STATUS#"), status, F.lit("#TIMESTAMP#"), stamp)).alias("index_key"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metric points from ``events``: the event type is the name."""
    return read_table(spark, d, "events", "ts", "event_type", "value").withColumnRenamed("event_type", "name")


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Failed steps from the error events, with the event they came from."""
    e = read_table(spark, d, "events")
    bad = F.col("event_type") == "error"
    return e.select(
        F.col("props").alias("event"), F.when(bad, F.repeat(F.concat(F.lit("failed at "), F.col("event_id").cast("string"), F.lit(" ")), F.lit(200))).alias("error_message"),
        F.when(F.col("value") < 20, "DETECTION").otherwise("REDACTION").alias("error_step"),
        F.concat(F.lit("doc-"), F.col("event_id").cast("string")).alias("document_id"), F.col("user_id").cast("string").alias("user_id"), "ts",
        F.when(F.col("value") >= 30, "recognition").when(F.col("value") >= 20, "scanner").alias("service"),
        F.when(F.col("value") >= 40, "Throttled").otherwise("").alias("error_type"), F.col("event_type"))


def users(spark: SparkSession, d: str) -> DataFrame:
    """Everyone who owns something: document sources and conversation roles."""
    a = read_table(spark, d, "documents", "source").select(F.col("source").alias("user_id")).distinct()
    b = read_table(spark, d, "conversations", "role").select(F.col("role").alias("user_id")).distinct()
    return a.unionByName(b)


def user_config(spark: SparkSession, d: str) -> DataFrame:
    """Stored settings of the sources, some fields missing, decided by the sources' totals; roles have none."""
    per = read_table(spark, d, "documents", "source", "n_chars").groupBy(F.col("source").alias("user_id")).agg(
        F.sum("n_chars").alias("t"))
    t = F.col("t")
    return per.select(
        "user_id", F.when(t % 4 == 0, "ai").when(t % 4 == 1, "regex").when(t % 4 == 2, "both").alias("method"),
        F.when(t % 3 == 0, True).when(t % 3 == 1, False).alias("residual_scan"),
        F.when(t % 5 < 3, t % 5 / 4.0).alias("temperature"),
        F.when(t % 7 < 4, F.concat(F.lit("Datos de "), F.col("user_id"), F.lit(": {text} INSTRUCCIONES: ninguna"))).alias("prompt"),
        F.when(t % 2 == 0, F.array(F.upper("user_id"), F.lit("  "))).alias("ignored"))


def toggles(spark: SparkSession, d: str) -> DataFrame:
    """Type switches of the sources, decided by the labels of their documents."""
    docs = read_table(spark, d, "documents", "doc_id", "source")
    marks = docs.join(read_table(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id").groupBy(
        F.col("source").alias("user_id")).agg(F.sum("quality").alias("q"), F.sum("toxic").alias("x"), F.count(F.lit(1)).alias("n"))
    kinds = F.array(*[F.struct(F.lit(t).alias("type"), (c % 2 == 0).alias("active")) for t, c in [
        ("EMAIL", F.col("q")), ("TARJETA_CREDITO", F.col("x")), ("TELEFONO", F.col("n")), ("TOKEN_GITHUB", F.col("q"))]])
    return marks.select("user_id", F.explode(kinds).alias("k")).select("user_id", "k.type", "k.active")


def ignored(spark: SparkSession, d: str) -> DataFrame:
    """Values to leave alone: what looks like an e-mail in labelled documents, shouted and padded."""
    docs = read_table(spark, d, "documents", "doc_id", "source", "text", spread=True)
    labelled = docs.join(read_table(spark, d, "labels", "doc_id"), "doc_id", "left_semi")
    found = labelled.select(F.col("source").alias("user_id"), F.explode(F.concat(
        F.regexp_extract_all("text", F.lit(r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]+"), F.lit(0)), F.array(F.lit("   ")))).alias("v"))
    return found.select("user_id", F.concat(F.lit("  "), F.upper("v"), F.lit("\t")).alias("value"))


def responses(pages: DataFrame) -> DataFrame:
    """A model's answer for each page: names with rough offsets, one made up, one odd, wrapped in prose."""
    names = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))
    items = F.transform(names, lambda n, i: F.to_json(F.struct(
        n.alias("text"), F.lit("nombre").alias("type"), (i * 50).alias("start_offset"))))
    odd = F.array(F.lit('42'), F.lit('{"text": 7, "type": "DNI", "start_offset": 0}'),
                  F.lit('{"text": "Nadie Aqui Zzz", "type": "NOMBRE", "start_offset": 3}'),
                  F.lit('{"text": "the", "type": "RARO", "start_offset": 3}'))
    body = F.concat(F.lit("["), F.array_join(F.concat(items, odd), ", "), F.lit("]"))
    text = (F.when(F.length("text") % 5 == 0, "sin corchetes").when(F.length("text") % 5 == 1, body)
            .otherwise(F.concat(F.lit("Encontrado: "), body, F.lit(" fin."))))
    return pages.withColumn("response", text)


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Scanner findings from ``documents``: one per document, on its stored file."""
    f = files(spark, d)
    n = F.col("doc_id")
    return f.select(
        F.concat(F.lit("f-"), n.cast("string")).alias("id"), F.lit("SensitiveData").alias("type"), F.col("name").alias("title"),
        F.when(F.col("size") < 50000000, "Low").when(F.col("size") < 200000000, "Medium").when(F.col("size") < 400000000, "High")
        .when(F.col("size") < 500000000, "").otherwise("Critical").alias("severity"),
        F.floor(F.col("size") / 65536).cast("bigint").alias("count"), "key",
        F.when(F.col("name").endswith(".md"), "other-bucket").otherwise("docs-bucket-123").alias("bucket"),
        F.when(F.col("name").endswith(".md"), "POLICY").otherwise("CLASSIFICATION").alias("category"),
        F.col("modified").alias("updated_at"))
