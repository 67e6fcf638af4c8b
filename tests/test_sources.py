import io
import json
import zipfile

from pyspark.sql import functions as F

from lodestore.sources import office, text

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACK = "http://schemas.openxmlformats.org/package/2006/relationships"
DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
DECK = "http://schemas.openxmlformats.org/presentationml/2006/main"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def relations(**targets):
    return f'<Relationships xmlns="{PACK}">' + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def p(t, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'


DOCX = package({
    "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{p("Title", "Heading1")}{p("长")}{p("度")}{p("body text")}<w:p><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:t>kept</w:t></w:r></w:p>'
    f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('0')}</w:tc></w:tr><w:tr><w:tc>{p('b')}{p('c')}</w:tc><w:tc/></w:tr></w:tbl>"
    f"<w:p><w:r><w:txbxContent>{p('box')}</w:txbxContent><w:txbxContent>{p('box')}</w:txbxContent></w:r></w:p></w:body></w:document>",
    "word/footnotes.xml": f'<w:footnotes xmlns:w="{WORD}"><w:footnote w:type="separator" w:id="0">{p("-")}</w:footnote><w:footnote w:id="2">{p("note")}</w:footnote></w:footnotes>',
})
XLSX = package({
    "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations(r1="worksheets/sheet1.xml"),
    "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><t>head</t></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><dimension ref="A1:ZZ9999"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><f>B1*2</f><v>4</v></c><c r="D1" s="3"/></row>'
    + "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(3, 63)) + "</sheetData></worksheet>",
})
SLIDE = f'<p:sld xmlns:p="{DECK}" xmlns:a="{DRAW}"><p:cSld><p:spTree><p:sp><a:p><a:r><a:t>top</a:t></a:r></a:p></p:sp><p:grpSp><p:sp><a:p><a:r><a:t>in group</a:t></a:r></a:p></p:sp></p:grpSp></p:spTree></p:cSld></p:sld>'
PPTX = package({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="{DECK}" xmlns:r="{REL}"><p:sldIdLst><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": relations(r1="slides/slide1.xml"),
    "ppt/slides/slide1.xml": SLIDE, "ppt/slides/_rels/slide1.xml.rels": relations(n="../notesSlides/notesSlide1.xml"), "ppt/notesSlides/notesSlide1.xml": SLIDE.replace("top", "said"),
})
DXF = "\n".join("0 SECTION 2 BLOCKS 0 BLOCK 2 B 0 TEXT 8 L1 1 inner 0 ENDBLK 0 ENDSEC 0 SECTION 2 ENTITIES 0 INSERT 2 B 0 TEXT 8 L0 1 12.5 0 MTEXT 8 L0 1 note 0 DIMENSION 1 99 0 ENDSEC 0 EOF".split(" ")).encode()


def test_word():
    found = office.word(DOCX)
    assert [(k, t) for k, _, t in found] == [("paragraph", "Title"), ("paragraph", "长度"), ("paragraph", "body text"), ("paragraph", "kept"), ("table", "a | 0\nb / c | "), ("textbox", "box"), ("footnote", "note")]
    assert found[1][1] == {"paragraph": 2, "section": "Title"}


def test_excel():
    found = office.excel(XLSX)
    assert [x[1]["range"] for x in found] == ["A1:C51", "A52:C62"]
    assert found[0][2].startswith("head | =B1*2 [缓存结果: 4]\n3 | ") and found[1][2].startswith("head | =B1*2")


def test_powerpoint():
    assert [(k, x.get("shape"), t) for k, x, t in office.powerpoint(PPTX)] == [("slide_text", "1", "top"), ("slide_text", "2.1", "in group"), ("slide_notes", None, "said\nin group")]


def test_dxf():
    assert [(x["layer"], t) for _, x, t in office.dxf(DXF)] == [("L0", "note"), ("L1", "inner")]


def test_parse_and_status(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, raw in {"a.docx": DOCX, "sub/b.xlsx": XLSX, "c.pptx": PPTX, "d.dxf": DXF, "bad.docx": b"no zip", "e.bin": b"?"}.items():
        (tmp_path / name).write_bytes(raw)
    files = text.listing(spark, str(tmp_path))
    chunks = office.parse(files)
    assert chunks.filter("kind = 'table'").count() == 3
    assert json.loads(chunks.filter("kind = 'slide_text'").orderBy("ordinal").first()["place"]) == {"shape": "1", "slide": 1}
    found = {r["path"].rsplit("/", 1)[-1]: r["status"] for r in office.statuses(files, chunks).collect()}
    assert found == {"a.docx": "ready", "b.xlsx": "ready", "c.pptx": "ready", "d.dxf": "ready", "bad.docx": "failed", "e.bin": "stored_only"}


def test_text_files(spark, tmp_path):
    (tmp_path / "u.md").write_bytes("﻿# One\n\n\n\nfirst\n\n# Two\nline\n\nlast\0".encode())
    (tmp_path / "g.txt").write_bytes("尺寸".encode("gb18030"))
    texts = text.decoded(text.listing(spark, str(tmp_path)))
    assert {r["path"][-4:]: len(r["warnings"]) for r in text.notices(texts).collect()} == {"u.md": 1, ".txt": 1} or {r["path"][-4:] for r in texts.collect()} == {"u.md", "g.txt"}
    rows = text.text_chunks(texts).filter(F.col("path").endswith("u.md")).orderBy("ordinal").collect()
    assert [(r["text"], r["paragraph"], r["section"]) for r in rows] == [("# One", 1, "One"), ("first", 3, "One"), ("# Two\nline", 4, "Two"), ("last", 5, "Two")]


def test_generations_and_failure_log(spark, tmp_path):
    text.write_generation(spark.range(3).toDF("chunk_id"), str(tmp_path / "c"), 1)
    text.write_generation(spark.range(5).toDF("chunk_id"), str(tmp_path / "c"), 2)
    assert text.read_active(spark, str(tmp_path / "c")).count() == 5
    spark.range(9).toDF("chunk_id").write.parquet(str(tmp_path / "c" / "generation=3"))  # written, but not switched to
    assert text.read_active(spark, str(tmp_path / "c")).count() == 5
    text.write_generation(spark.range(3).toDF("chunk_id"), str(tmp_path / "c"), 1)  # back again
    assert text.read_active(spark, str(tmp_path / "c")).count() == 3
    events = spark.sql("select timestamp'2024-01-02 03:04:05' at, 'parse' kind, 'bad\nfile' message, map('b', '2', 'a', '1') details")
    text.append_failures(events, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first()[0] == "2024-01-02T03:04:05 | parse | bad file | a=1 b=2"


def test_rich_pictures_and_shapes():
    anchor = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
    raw = package({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations(r1="worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData><row r="1"><c r="B1" t="e" vm="1"><v>#VALUE!</v></c><c r="C1" vm="9"/></row></sheetData></worksheet>',
        "xl/metadata.xml": f'<metadata xmlns="{SHEET}"><futureMetadata name="XLRICHVALUE"><bk><rvb i="0"/></bk></futureMetadata><valueMetadata><bk><rc t="1" v="0"/></bk></valueMetadata></metadata>',
        "xl/richData/rdrichvalue.xml": "<rvData><rv><v>0</v><v>5</v></rv></rvData>", "xl/richData/richValueRel.xml": f'<richValueRels xmlns:r="{REL}"><rel r:id="p"/></richValueRels>',
        "xl/richData/_rels/richValueRel.xml.rels": relations(p="../media/image1.png"),
        "xl/drawings/drawing1.xml": f'<d:wsDr xmlns:d="{anchor}" xmlns:a="{DRAW}"><d:twoCellAnchor><d:from><d:col>1</d:col><d:row>3</d:row></d:from><d:sp><a:p><a:r><a:t>callout</a:t></a:r></a:p></d:sp></d:twoCellAnchor></d:wsDr>',
    })
    assert office.rich_pictures(raw) == {"S": [("B1", "xl/media/image1.png")]}
    assert office.sheet_shapes(raw, "xl/drawings/drawing1.xml") == [("B4", "callout")]


def test_folder_digest(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).write_bytes(n.encode())
    first = text.folder_digest(text.listing(spark, str(tmp_path))).first()
    (tmp_path / "b").write_bytes(b"c")
    second = text.folder_digest(text.listing(spark, str(tmp_path))).first()
    assert first["files"] == second["files"] == 2 and first["digest"] != second["digest"]
