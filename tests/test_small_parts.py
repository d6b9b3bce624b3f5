from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from textloom.functions import providers
from textloom.operators import answers as A
from textloom.operators import chunking as C
from textloom.plans.ingestion import ingest_texts
from textloom.sources import files


def test_properties_of_docx_and_html(spark, tmp_path):
    out = io.BytesIO(files.docx_file(["A paragraph"]))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:title>The title</dc:title><dc:creator> </dc:creator><dcterms:created>2024-05-06T07:08:09Z</dcterms:created></cp:coreProperties>')
    (tmp_path / "a.docx").write_bytes(out.getvalue())
    (tmp_path / "b.docx").write_bytes(files.docx_file(["x"]))
    (tmp_path / "c.html").write_text("<title>Page</title><meta name='author' content='Ann'>")
    (tmp_path / "d.txt").write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in files.native_properties(files.discover(spark, str(tmp_path))).collect()}
    assert rows == {"a.docx": ("The title", None, "2024-05-06T07:08:09Z"), "b.docx": (None,) * 3, "c.html": ("Page", "Ann", None), "d.txt": (None,) * 3}


def test_texts_come_again_as_documents(spark):
    english = "the cat and the dog were in the house with all of their friends and they sang. " * 4
    french = "le chat et la maison dans les bois pour que une des grandes choses et le jour. " * 4
    rows = [("in/a.txt", english, 88.5), ("b.x.txt", french, None), ("c.txt", "  \n", 10.0), ("d.txt", english.upper(), 70.0)]
    stored = spark.createDataFrame([("old.pdf", french), ("a.pdf", english)], "filename string, text string")
    batch = ingest_texts(spark.createDataFrame(rows, "filename string, text string, ocr_confidence double"), stored)
    meta = {r["filename"]: r for r in batch.metadata.collect()}
    assert set(meta) == {"a.pdf", "b.x.pdf", "d.pdf"} and {r["filename"] for r in batch.rejects.collect()} == {"c.pdf"}
    assert meta["a.pdf"]["chunking_strategy_used"] == "recursive" and meta["b.x.pdf"]["chunking_strategy_used"] == "semantic"
    assert meta["a.pdf"]["ocr_confidence"] == 88.5 and meta["a.pdf"]["ingested_via"] == "ocr_text" and not meta["a.pdf"]["is_duplicate"]
    assert meta["b.x.pdf"]["duplicate_of"]["filename"] == "old.pdf" and meta["d.pdf"]["duplicate_of"] is None  # a.pdf comes again itself
    assert {(r["filename"], r["strategy"]) for r in batch.chunks.collect()} == {("a.pdf", "recursive"), ("b.x.pdf", "semantic"), ("d.pdf", "recursive")}


def test_rechunk_names_chunks_by_stem(spark):
    meta = spark.createDataFrame([("x/one.pdf",), ("two.docx",), ("x/one.html",)], "filename string")
    texts = spark.createDataFrame([("one.txt", "a b c"), ("three.txt", "d"), ("y/two.txt", "e f")], "filename string, text string")
    rows = C.rechunk(meta, texts, "fixed").select("filename", "text", "strategy").collect()
    assert sorted(map(tuple, rows)) == [("two.docx", "e f", "fixed"), ("x/one.html", "a b c", "fixed")]


def test_pairs_for_models_with_instructions(spark):
    run = lambda instruction, text: F.concat_ws("|", instruction, text)
    df = spark.createDataFrame([("t",)], "t string")
    assert df.select(providers.embed_pairs(F.col("t"), "instructor-xl", run), providers.embed_pairs(F.col("t"), "instructor-xl", run, question=True)).first()[:] == ("Represent the document for retrieval:|t", "Represent the question for retrieving supporting documents:|t")


def test_issues_are_told_on_a_retry_only(spark):
    kind = "id int, query string, retry boolean, issues string, chunks array<struct<chunk_id:string,source_doc:string,text:string,score:double>>"
    hit = [("c", "d", "Text.", 0.9)]
    df = spark.createDataFrame([(1, "q", False, "bad", hit), (2, "q", True, "bad", hit), (3, "q", True, "bad", [])], kind)
    out = {r["id"]: (r["answer"], r["confidence"]) for r in A.summarise(df, lambda q, context, issues: F.concat(q, F.lit(" "), F.coalesce(issues, F.lit("first")))).collect()}
    assert out == {1: ("q first", "high"), 2: ("q bad", "high"), 3: (A.NOTHING_FOUND, "low")}
