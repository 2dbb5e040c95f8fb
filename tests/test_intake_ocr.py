import json

from pyspark.sql import functions as F

from tachado.operators import aggregate, geometry, intake, locate, ocr, overlap
from tachado.operators.running import total_before
from tachado.sources import files

BLOCK = "doc_id string, id string, block_type string, page int, text string, left double, top double, width double, height double, relationships array<struct<type:string,ids:array<string>>>, ord int"


def event(key, bucket="b", size=5):
    return json.dumps({"Records": [{"s3": {"bucket": {"name": bucket}, "object": {"key": key, "size": size}}}, {"s3": {"bucket": {"name": "z"}, "object": {"key": "z"}}}]})


def test_events_and_keys(spark):
    rows = [event("originales/u1/mi+archivo%20x.pdf"), event("x%zz"), event("k", bucket=""), event(""), '{"Records": []}', "no json"]
    df = intake.parse_file_events(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, event string"))
    got = {r.i: (r.bucket, r.key, r["size"], r.error_reason) for r in df.collect()}
    assert got[0] == ("b", "originales/u1/mi archivo x.pdf", 5, None)
    assert got[1][1] == "x%zz" and got[2][3] == "no_bucket" and got[3][3] == "no_key" and got[4][3] == got[5][3] == "no_records"
    keys = [("originales/u1/t.pdf", ("u1", "t.pdf", None)), ("originales/u1/sub/x.pdf", ("u1", "sub/x.pdf", None)), ("ofuscados/u/f.pdf", (None, None, "wrong_prefix")),
            ("originales/f.pdf", (None, None, "wrong_pattern")), ("originales/", (None, None, "wrong_pattern")), ("originales//f.pdf", (None, None, "no_user")), ("originales/u/", (None, None, "no_file"))]
    out = intake.split_object_key(spark.createDataFrame([(k,) for k, _ in keys], "key string"))
    assert [(r.user_id, r.file_name, r.error_reason) for r in out.collect()] == [e for _, e in keys]


def test_validation_order_and_quarantine(spark):
    rows = [(0, b"%PDF-1.7", None), (524287999, b"%PDF", None), (524288000, b"PK", "too_large: 500.0MB (max 500MB)"), (524550144, b"%PDF", "too_large: 500.2MB (max 500MB)"), (9, b"PK..", "no_pdf_header"), (0, b"", "no_pdf_header")]
    df = spark.createDataFrame([(n, bytearray(c), "u", f"d{i}", f"originales/u/d{i}") for i, (n, c, _) in enumerate(rows)], "length bigint, content binary, user_id string, document_id string, key string").withColumn("file_name", F.col("document_id"))
    checked = intake.validate_files(df)
    assert [r.error_reason for r in checked.collect()] == [e for *_, e in rows]
    good, bad = intake.route_invalid(checked)
    assert good.count() == 2 and sorted(r.error_key for r in bad.collect())[0] == "errores/u/d2/d2"


def test_prefixes_and_ownership(spark):
    cases = [("", "originales/u/"), ("originales/", "originales/u/"), ("/ofuscados/u/x", "ofuscados/u/x"), ("ofuscados/w/x", None), ("otros/u/", "originales/u/"), ("originales", "originales/u/"), ("errores/uu/", None)]
    df = spark.createDataFrame([(p,) for p, _ in cases], "p string")
    assert [r[0] for r in df.select(intake.scope_prefix("p", F.lit("u"))).collect()] == [e for _, e in cases]
    keys = [("originales/u/x", True), ("", False), ("originales/u/../x", False), ("originales/uu/x", False), ("x/u", True), ("u/x", False)]
    df = spark.createDataFrame([(k,) for k, _ in keys], "k string")
    assert [r[0] for r in df.select(intake.owned_key("k", F.lit("u"))).collect()] == [e for _, e in keys]


def test_folder_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF-1.4 hola")
    (tmp_path / "y.pdf").write_bytes(b"PK")
    (tmp_path / "z.txt").write_bytes(b"%PDF")
    listed = files.list_files(spark, str(tmp_path), "*.pdf").collect()
    assert sorted((r.name, r["size"]) for r in listed) == [("x.pdf", 13), ("y.pdf", 2)]
    checked = {r.path.rsplit("/", 1)[1]: r.error_reason for r in files.validate_folder(spark, str(tmp_path), "*.pdf", max_bytes=10).collect()}
    assert checked["x.pdf"].startswith("too_large") and checked["y.pdf"] == "no_pdf_header"
    plan = files.validate_folder(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(length" in plan


def _blocks():
    rel = [("CHILD", ["w2", "gone", "w1", "l1"]), ("VALUE", ["w3"])]
    return [("d", "l3", "LINE", 2, "p2", .1, .1, .1, .1, None, 0), ("d", "l2", "LINE", 1, "abajo", .1, .8, .1, .1, None, 1), ("d", "l1", "LINE", None, "der", .6, .1, .1, .1, rel, 2),
            ("d", "l0", "LINE", 1, "izq", .1, .1, .1, .1, None, 3), ("d", "p", "PAGE", 1, "zz", None, None, None, None, None, 4), ("d", "lz", "LINE", 1, None, None, None, None, None, None, 5),
            ("d", "w1", "WORD", 1, "uno", .6, .1, .05, .1, None, 6), ("d", "w2", "WORD", 1, "dos", .7, .1, .05, .1, None, 7), ("d", "w3", "WORD", 1, "tres", .7, .1, .05, .1, None, 8)]


def test_blocks_to_pages_words_and_back(spark, tmp_path):
    blocks = spark.createDataFrame(_blocks(), BLOCK)
    pages = ocr.ocr_pages(blocks)
    assert {r.page: r.text for r in ocr.page_text(pages).collect()} == {1: "\nizq\nder\nabajo", 2: "p2"}
    words = ocr.attach_words(blocks)
    assert [(r.line_id, r.text) for r in words.orderBy("word_ord").collect()] == [("l1", "dos"), ("l1", "uno")]
    nested = ocr.blocks_document(pages, words).select(F.col("doc_id").alias("documentId"), F.array(F.struct("pageNumber", "blocks")).alias("pages"), F.lit(2).alias("totalPages"), F.lit(None).cast("string").alias("error"))
    files.write_ocr(nested, str(tmp_path / "o"))
    back = files.read_ocr(spark, str(tmp_path / "o"))
    assert {r.page: r.text for r in files.ocr_page_text(back).collect()} == {1: "\nizq\nder\nabajo", 2: "p2"}
    assert "error" not in spark.read.json(str(tmp_path / "o")).columns
    got = ocr.ocr_words(spark.read.schema("documentId string, pages " + __import__("tachado.schemas", fromlist=["x"]).OCR_FIELDS["pages"]).json(str(tmp_path / "o")).withColumnRenamed("documentId", "doc_id"))
    assert [r.text for r in got.orderBy("word_ord").collect()] == ["dos", "uno"]


def test_unnumbered_pages(spark, tmp_path):
    doc = {"documentId": "d", "pages": [{"blocks": [{"type": "LINE", "text": "a"}]}, {"pageNumber": 7, "blocks": [{"type": "LINE", "text": "b"}, {"type": "WORD", "text": "no"}]}]}
    (tmp_path / "o.json").write_text(json.dumps(doc, indent=2))
    for by_place, expected in [(False, [1, 7]), (True, [1, 7])]:
        got = files.read_ocr(spark, str(tmp_path), by_place, multi_line=True)
        assert sorted(r.page for r in got.collect()) == expected
    wanted = spark.createDataFrame([("d", 1), ("d", 2), ("d", 7), ("d", 9)], "doc_id string, page int")
    stored = spark.read.schema("documentId string, pages array<struct<pageNumber:int>>").option("multiLine", True).json(str(tmp_path)).withColumnRenamed("documentId", "doc_id")
    assert {r.page: r.pos for r in ocr.page_lookup(wanted, ocr.page_rows(stored)).collect()} == {1: 0, 2: 1, 7: 1}


def test_entity_files(spark, tmp_path):
    rows = [("d", 1, 0, "DNI", 5, 9, "x", "regex", .95), ("d", 2, 0, "A", 0, 1, "y", "bedrock", .85), ("d", 1, 1, "B", 0, 2, "z", "otro", .5)]
    ents = spark.createDataFrame(rows, "doc_id string, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double")
    docs = aggregate.entities_document(ents)
    one = docs.filter("page = 1").first()
    assert one.totalEntities == 3 and one.sourceContributions == {"bedrock": 1, "regex": 1} and [e.startOffset for e in one.entities] == [0, 5]
    files.write_entities(docs, str(tmp_path / "e"), by_document=True)
    back = files.read_entities(spark, str(tmp_path / "e"), spark.createDataFrame([("d",), ("nada",)], "doc_id string"))
    assert sorted((r.doc_id, r.page, r.type) for r in back.collect() if r.page) == [("d", 1, "B"), ("d", 1, "DNI"), ("d", 2, "A")]
    assert back.filter("doc_id = 'nada' and type is null").count() == 1


def test_report_files_read_in_page_order(spark, tmp_path):
    rows = [("u", "d", i, f"linea {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "user_id string, doc_id string, section int, body string").repartition(7)
    files.write_reports(df, str(tmp_path / "r"), by_document=True)
    files.write_reports(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 200
    parts = sorted((tmp_path / "r" / "user_id=u" / "doc_id=d").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split("\n")[:-1] == [f"linea {i}" for i in range(200)]


def test_running_totals_across_stretches(spark):
    df = spark.createDataFrame([("h", i, i % 5) for i in range(1000)] + [("k", 3, 9)], "doc_id string, page int, n int")
    got = {(r.doc_id, r.page): r.before for r in total_before(df, ["doc_id"], "page", F.col("n"), "before", width=64).collect()}
    assert all(got["h", i] == sum(j % 5 for j in range(i)) for i in range(1000)) and got["k", 3] == 0


WORD = "doc_id int, page int, word_ord int, text string, x0 double, y0 double, x1 double, y1 double, block int, line int"


def _words(texts, lines=None):
    return [(1, 1, i, t, i * 10.0, 0.0, i * 10.0 + 8, 5.0, 0, (lines or [0] * len(texts))[i]) for i, t in enumerate(texts)]


def test_tolerant_location(spark):
    cases = [("MARIA LOPEZ", ["MARÍA", "LÓPEZ"], None, [(0, 1)], 1), ("+54 911 12345678", ["+54", "9", "11", "12345678"], None, [(0, 3)], 1),
             ("Olmos 12 Pilar", ["Olmos", "12", "-", "Pilar"], None, [(0, 3)], 1), ("a b c", ["a", "b", "c"], [0, 0, 1], [(0, 2)], 2), ("zz", ["a"], None, [], 0), ("--", ["a"], None, [], 0),
             ("ab", ["abx", "ab", "xab", "a", "b"], None, [(0, 0), (1, 1), (3, 4)], 3), ("aa", ["a", "a", "a"], None, [(0, 1)], 1), ("a.b", ["a.b.c"], None, [(0, 0)], 1)]
    for text, words, lines, runs, boxes in cases:
        w = spark.createDataFrame(_words(words, lines), WORD)
        e = spark.createDataFrame([(1, 1, 0, text)], "doc_id int, page int, ord int, text string")
        got = locate.locate_tolerant(e, w, ["x0", "y0", "x1", "y1", "block", "line"])
        assert sorted((r.first_word, r.last_word) for r in got.collect()) == runs, text
        assert geometry.boxes_per_line(got, ["doc_id", "page", "ord", "occurrence"]).count() == boxes, text


def test_where_an_entity_is_found(spark):
    pages = spark.createDataFrame([(1, 1, "Ana Paz vive"), (1, 2, "nadie --- aquí"), (1, 3, "José  María en casa, xAna Pazx"), (2, 1, "Ana")], "doc_id int, page int, text string")
    words = pages.select("doc_id", "page", F.posexplode(F.split("text", " +")).alias("word_ord", "text"))
    ents = spark.createDataFrame([(1, 1, 0, "Ana Paz"), (1, 1, 1, "ANA-PAZ"), (1, 2, 2, "JOSE MARIA"), (1, 2, 3, "Eva"), (1, 1, 4, "---"), (1, 2, 5, "azx"), (2, 1, 6, "Jose"), (1, 2, 7, "")], "doc_id int, page int, ord int, text string")
    ocr_words = spark.createDataFrame([(1, 2, 0, "Éva")], "doc_id int, page int, word_ord int, text string")
    got = {r.ord: (r.how, r.found_page) for r in locate.locate(ents, pages, words, ocr_words).collect()}
    assert got == {0: ("exact", 1), 1: ("tolerant", 1), 2: ("other_page", 3), 3: ("ocr", 2), 4: ("other_page", 2), 5: ("other_page", 3), 6: ("missing", None)}


def test_boxes(spark):
    rows = [(1, 1, 0, 0., 0., 10., 10.), (1, 1, 1, 5., 0., 15., 10.), (1, 1, 2, 6., 0., 16., 10.), (1, 1, 3, 2., 2., 2., 9.), (1, 1, 4, 15.5, 0., 25., 10.)]
    df = spark.createDataFrame(rows, "doc_id int, page int, box_ord int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.box_ord for r in geometry.dedup_boxes(df).collect()) == [0, 2, 3, 4]
    spans = spark.createDataFrame([(1, 1, 0, 0., 0., 4., 10., 9.), (1, 1, 1, 4., 0., 10., 10., 12.), (1, 1, 2, 0., 0., 99., 99., 0.)], "doc_id int, page int, span_ord int, x0 double, y0 double, x1 double, y1 double, size double")
    sizes = {r.box_ord: r.font_size for r in geometry.font_size(df, spans).collect()}
    assert sizes[0] == 12.0 and sizes[4] == 0.0


def test_occurrences(spark):
    pages = spark.createDataFrame([(1, 1, "ana ana banana"), (1, 2, "x")], "doc_id int, page int, text string")
    ents = spark.createDataFrame([(1, 1, 0, "N", 0, 3, "ana", "regex", .9), (1, 1, 1, "B", 0, 3, "banana", "regex", .9)], "doc_id int, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double")
    got = {r.page: (r.masked_text, r.occurrences_masked) for r in locate.mask_occurrences(pages, ents).collect()}
    assert got == {1: ("[N-R] [N-R] b[N-R]na", 3), 2: ("x", 0)}


def test_every_spelling_is_masked(spark):
    pages = spark.createDataFrame([(1, 1, "Ana Paz y ANA PAZ y Ana  Paz, aná-paz")], "doc_id int, page int, text string")
    ents = spark.createDataFrame([(1, 1, 0, "NOMBRE", 0, 7, "Ana Paz", "bedrock", .9)], "doc_id int, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double")
    got = locate.mask_occurrences(pages, ents).first()
    assert (got.masked_text, got.occurrences_masked) == ("[NOMBRE-IA] y [NOMBRE-IA] y [NOMBRE-IA] [NOMBRE-IA]", 4)


def test_spelled_and_strayed_occurrences(spark):
    pages = spark.createDataFrame([(1, 1, "Hola JOSÉ  María, ana"), (1, 2, "Ana Paz y Ana Paz"), (2, 1, "x")], "doc_id int, page int, text string")
    rows = [(1, 1, 0, "NOMBRE", 0, 3, "jose maria", "bedrock", .8), (1, 1, 1, "NOMBRE", 0, 3, "Ana Paz", "bedrock", .8), (2, 1, 0, "DNI", 0, 3, "Ana", "regex", .8), (1, 1, 2, "X", 0, 1, "ana", "regex", .9)]
    ents = spark.createDataFrame(rows, "doc_id int, page int, ord int, type string, start_offset int, end_offset int, text string, source string, confidence double")
    moved = locate.relocate(ents, pages)
    assert sorted((r.doc_id, r.page, r.text) for r in moved.collect()) == [(1, 1, "ana"), (1, 1, "jose maria"), (1, 2, "Ana Paz"), (2, 1, "Ana")]
    got = {(r.doc_id, r.page): (r.masked_text, r.occurrences_masked) for r in locate.mask_occurrences(pages, moved).collect()}
    assert got == {(1, 1): ("Hola [NOMBRE-IA] [X-R]", 2), (1, 2): ("[NOMBRE-IA] y [NOMBRE-IA]", 2), (2, 1): ("x", 0)}


def test_files_as_they_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF hola")
    stream = files.stream_files(spark, str(tmp_path / "in"), recursiveFileLookup="true", schema=spark.read.format("binaryFile").load(str(tmp_path / "in")).schema)
    checked = intake.validate_files(stream).select("path", "length", "error_reason")
    q = checked.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.length, r.error_reason) for r in spark.table("arrived").collect()] == [(9, None)]
