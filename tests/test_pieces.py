"""Page rules, Word files, sinks and streams on small cases."""

import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from weftline.operators import geometry, normalize
from weftline.sources import readers, sinks
from weftline.streaming import stream


def test_preliminary_pages(spark):
    contents = ["1 Methods .......... 3", "2 Results .......... 9", "3 Ends .......... 12"]
    prose = ["word " * 40, "other " * 60]
    rows = [
        (1, 0, ["A short cover"], [], None), (1, 1, contents, [], None), (1, 2, prose, ["1 Methods"], "3"), (1, 3, prose, ["2 Results"], "4"),
        (1, 4, prose, ["3 Ends"], "5"), (1, 5, prose, [], "vi"), (2, 0, contents, [], "i"), (3, 0, [], [], None), (3, 1, prose, [], "2"), (3, 2, prose, [], None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page int, lines array<string>, headings array<string>, label string")
    got = {(r.doc_id, r.page) for r in geometry.preliminary_pages(df).collect() if r.preliminary}
    assert got == {(1, 0), (1, 1), (3, 0)}


def test_wrapped_lines_are_joined(spark):
    blocks = [["A sen-", "tence that", "goes  on.", "Next One", "## Head", "lower after", "- item", "", "a­b"], [], None]
    got = [r.j for r in spark.createDataFrame([(b,) for b in blocks], "b array<string>").select(geometry.joined_lines("b").alias("j")).collect()]
    assert got == [["A sentence that goes on.", "Next One", "## Head", "lower after", "- item", "ab"], [], []]


def word_file(*body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def paragraph(text: str, style: str = "") -> str:
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def test_files_are_read(spark, tmp_path):
    row = "<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in "ab") + "</w:tr>"
    whole = word_file(paragraph("T", "Title"), paragraph("1 A ... 2", "TOC1"), paragraph("x", "ListBullet"), paragraph("F", "Caption"), paragraph(""), f"<w:tbl>{row}{row}</w:tbl>", paragraph("end"))
    (tmp_path / "a.DOCX").write_bytes(whole)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    (tmp_path / "c.docx").write_bytes(whole)
    (tmp_path / "d.txt").write_text("one\ntwo\n")
    files = readers.read_files(spark, str(tmp_path))
    assert files.select("asset_key").distinct().count() == 3
    lines = readers.docx_lines(readers.read_docx(files)).orderBy("path", "ordinal").collect()
    assert [r.line for r in lines] == ["## T", "- x", "! F", "| a | b |", "| a | b |", "end"] * 2
    (text,) = readers.read_texts(spark, str(tmp_path / "d.txt")).collect()
    assert text.text == "one\ntwo\n" and text.path.endswith("d.txt")


def test_decks_and_their_files(spark, tmp_path):
    deck = spark.range(20).selectExpr("id % 5 AS request_id", "int(id) AS pos", "'t' AS title")
    path = str(tmp_path / "deck")
    sinks.write_deck(deck, path)
    sinks.write_deck(deck.limit(1), path)
    assert spark.read.parquet(path).drop("bucket").exceptAll(deck).count() == 0 and spark.read.parquet(path).count() == 20
    sinks.write_deck(deck.limit(1), path, again=True)
    assert spark.read.parquet(path).count() == 1
    rows = [(("a.pptx", ["b.png", None, "", "b.png"]),), ((None, None),)]
    df = spark.createDataFrame(rows, "p struct<file_path:string,assets:array<string>>")
    assert [r.f for r in df.select(sinks.artifacts(F.col("p")).alias("f")).collect()] == [["a.pptx", "a.pdf", "b.png"], []]


def test_prompts_are_answered_once_while_they_live(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 10, m), p, n) for m, p, n in ((0, "a", 5), (5, "a", 5), (6, "a", 6), (7, "b", 5))]
    spark.createDataFrame(rows, "ts timestamp, prompt string, requested int").write.parquet(str(tmp_path / "in"))
    asked = stream.memoised(stream.document_stream(spark, str(tmp_path / "in"), "ts timestamp, prompt string, requested int"))
    asked.writeStream.format("memory").queryName("asked_once").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.prompt, r.requested) for r in spark.table("asked_once").collect()) == [("a", 5), ("a", 6), ("b", 5)]


def test_sections_of_a_stream_are_those_of_the_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# One\n\nfirst words here\n\n## Two\n\nmore words here"), (2, "plain words only")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    from weftline.operators.structure import structure

    arriving = stream.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    stream.sections_sink(arriving, str(tmp_path / "out"), str(tmp_path / "state"), normalize.normalise).trigger(availableNow=True).start().awaitTermination()
    got, want = spark.read.parquet(str(tmp_path / "out")).drop("batch"), structure(normalize.normalise(docs))[1]
    assert got.count() == want.count() > 0 and got.select(want.columns).exceptAll(want).count() == 0
