"""Office documents (zipped XML) and DXF drawings as located chunks, with the standard library alone.

``parse(files)`` turns rows of ``path`` and ``content`` into rows of ``path``, ``ordinal``, ``kind``, ``place`` (JSON of
where the chunk stands) and ``text``. Formats without a parser give no chunks and the status ``stored_only``.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_BYTES, MOST_CELLS = 20_000, 256 << 20, 1_000_000
TILE = 50
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

Found = tuple[str, dict, str]


class TooLarge(ValueError):
    pass


def opened(raw: bytes) -> zipfile.ZipFile:
    """A package within the limits on entries and expanded size (SRC09)."""
    package = zipfile.ZipFile(io.BytesIO(raw))
    infos = package.infolist()
    if len(infos) > MOST_ENTRIES or sum(i.file_size for i in infos) > MOST_BYTES:
        raise TooLarge("package exceeds its limits")
    return package


def xml(package: zipfile.ZipFile, name: str) -> ET.Element | None:
    try:
        return ET.fromstring(package.read(name))
    except KeyError:
        return None


def related(package: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Relation id to the part it names."""
    folder, name = posixpath.split(part)
    root = xml(package, f"{folder}/_rels/{name}.rels")
    out = {}
    for x in root if root is not None else ():
        if x.get("TargetMode") != "External":
            target = x.get("Target", "")
            out[x.get("Id", "")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return out


# Word


def paragraph_text(p: ET.Element) -> str:
    """Runs of a paragraph without deleted text; notes as marks (SRC05). Text boxes are read elsewhere."""
    out: list[str] = []

    def walk(e: ET.Element) -> None:
        if e.tag in (f"{W}del", f"{W}txbxContent", f"{W}pPr"):
            return
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
        elif e.tag == f"{W}footnoteReference":
            out.append(f"[脚注 {e.get(f'{W}id')}]")
        for child in e:
            walk(child)

    walk(p)
    return "".join(out).strip()


def joined_cells(rows: list[list[str | None]]) -> str:
    """Cells by bars, rows by line breaks, inner breaks as slashes; only None is empty (SRC06)."""
    return "\n".join(" | ".join("" if c is None else str(c).replace("\n", " / ") for c in row) for row in rows)


def word_rows(table: ET.Element) -> list[list[str]]:
    """A cell's paragraphs and nested tables in one text; merged cells appear once, as they are stored once."""
    rows = []
    for tr in table.iter(f"{W}tr"):
        rows.append(["\n".join(filter(None, (paragraph_text(p) for p in tc.iter(f"{W}p")))) for tc in tr.findall(f"{W}tc")])
    return rows


def word(raw: bytes) -> list[Found]:
    """Body in order: short paragraphs without digits join the next ones, headings set the section (SRC03); then text
    boxes, once a content (SRC04), and notes (SRC05)."""
    package = opened(raw)
    root = xml(package, "word/document.xml")
    body = root.find(f"{W}body") if root is not None else None
    if body is None:
        return []
    out: list[Found] = []
    section, nth, short, first = "", 0, [], 0

    def flush() -> None:
        if short:
            out.append(("paragraph", {"paragraph": first, "section": section}, "".join(short)))
            short.clear()

    for e in body:
        if e.tag == f"{W}p":
            nth += 1
            style = e.find(f"{W}pPr/{W}pStyle")
            text = paragraph_text(e)
            if not text:
                continue
            if style is not None and (style.get(f"{W}val") or "").startswith("Heading"):
                flush()
                section = text
            if len(text) <= 2 and not re.search(r"\d", text):
                first = nth if not short else first
                short.append(text)
                continue
            flush()
            out.append(("paragraph", {"paragraph": nth, "section": section}, text))
        elif e.tag == f"{W}tbl":
            flush()
            out.append(("table", {"section": section, "table": sum(k == "table" for k, _, _ in out) + 1}, joined_cells(word_rows(e))))
    flush()
    seen = set()
    for box in root.iter(f"{W}txbxContent"):
        text = "\n".join(filter(None, (paragraph_text(p) for p in box.iter(f"{W}p"))))
        if text and text not in seen:
            seen.add(text)
            out.append(("textbox", {"textbox": len(seen)}, text))
    for part, kind in (("word/footnotes.xml", "footnote"), ("word/endnotes.xml", "endnote")):
        notes = xml(package, part)
        for note in notes if notes is not None else ():
            text = "\n".join(filter(None, (paragraph_text(p) for p in note.iter(f"{W}p"))))
            if text and note.get(f"{W}type") not in ("separator", "continuationSeparator", "continuationNotice"):
                out.append((kind, {"id": note.get(f"{W}id")}, text))
    return out


def content_figures(raw: bytes, longer_cm: float = 4.0) -> int:
    """Inline and anchored pictures whose longer side exceeds 4 cm (SRC07)."""
    root = xml(opened(raw), "word/document.xml")
    sizes = [max(int(e.get("cx", 0)), int(e.get("cy", 0))) for e in root.iter("{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}extent")] if root is not None else []
    return sum(s > longer_cm * 360_000 for s in sizes)


# Excel


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def sheet_cells(package: zipfile.ZipFile, part: str, strings: list[str]) -> dict[tuple[int, int], str]:
    """Non-empty cells only, so styled empty ones and false dimensions do not count (SRC08); formulas with their stored
    result, or a mark where there is none (SRC10)."""
    root, cells = xml(package, part), {}
    for c in root.iter(f"{S}c") if root is not None else ():
        value, formula, kind = c.find(f"{S}v"), c.find(f"{S}f"), c.get("t")
        text = value.text if value is not None else None
        if kind == "s" and text is not None:
            text = strings[int(text)]
        elif kind == "inlineStr":
            text = "".join(t.text or "" for t in c.iter(f"{S}t"))
        elif kind == "b" and text is not None:
            text = "TRUE" if text == "1" else "FALSE"
        if formula is not None and formula.text:
            text = f"={formula.text} " + (f"[缓存结果: {text}]" if text is not None else "[缓存结果缺失]")
        if text is not None and text.strip():
            row = int(re.search(r"\d+", c.get("r"))[0])
            cells[row, column_number(c.get("r"))] = text
            if len(cells) > MOST_CELLS:
                raise TooLarge("sheet exceeds its limit of cells")
    return cells


def excel(raw: bytes) -> list[Found]:
    """Sheets in tiles of 50 rows, the first row again at the head of later tiles; empty rows and columns left out (SRC10)."""
    package = opened(raw)
    shared = xml(package, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared] if shared is not None else []
    book, parts = xml(package, "xl/workbook.xml"), related(package, "xl/workbook.xml")
    out: list[Found] = []
    for sheet in book.iter(f"{S}sheet") if book is not None else ():
        cells = sheet_cells(package, parts.get(sheet.get(f"{R}id"), ""), strings)
        rows, columns = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
        for at in range(0, len(rows), TILE):
            tile = rows[at : at + TILE]
            shown = ([rows[0]] if at else []) + tile
            area = f"{column_name(columns[0])}{tile[0]}:{column_name(columns[-1])}{tile[-1]}"
            out.append(("table", {"sheet": sheet.get("name"), "range": area, "source_rows": [tile[0], tile[-1]]}, joined_cells([[cells.get((r, c)) for c in columns] for r in shown])))
    return out


X = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"


def rich_pictures(raw: bytes) -> dict[str, list[tuple[str, str]]]:
    """Of each sheet the cells with a picture as their value, and the picture's part (SRC11).

    A cell's value metadata names a record, which names a rich value, which names a relation, which names the part;
    each step is a lookup, and a chain that breaks gives no picture.
    """
    package = opened(raw)
    book, parts = xml(package, "xl/workbook.xml"), related(package, "xl/workbook.xml")
    local = lambda root, name: [e for e in root.iter() if e.tag.rsplit("}", 1)[-1] == name] if root is not None else []
    metadata, rich, names = (xml(package, f"xl/{n}.xml") for n in ("metadata", "richData/rdrichvalue", "richData/richValueRel"))
    records = [next((int(rc.get("v", -1)) for rc in local(bk, "rc")), -1) for m in local(metadata, "valueMetadata") for bk in m]
    values = [next((int(rvb.get("i", -1)) for rvb in local(bk, "rvb")), -1) for m in local(metadata, "futureMetadata") if m.get("name") == "XLRICHVALUE" for bk in m]
    relations = [next((int(v.text) for v in local(rv, "v") if (v.text or "").isdigit()), -1) for rv in local(rich, "rv")]
    ids = [e.get(f"{R}id", "") for e in local(names, "rel")]
    targets = related(package, "xl/richData/richValueRel.xml")
    at = lambda rows, k: rows[k] if k is not None and 0 <= k < len(rows) else None
    out: dict[str, list[tuple[str, str]]] = {}
    for sheet in book.iter(f"{S}sheet") if book is not None else ():
        root = xml(package, parts.get(sheet.get(f"{R}id"), ""))
        for c in root.iter(f"{S}c") if root is not None else ():
            if c.get("vm"):
                part = targets.get(at(ids, at(relations, at(values, at(records, int(c.get("vm")) - 1)))) or "")
                if part:
                    out.setdefault(sheet.get("name"), []).append((c.get("r"), part))
    return out


def sheet_shapes(raw: bytes, part: str) -> list[tuple[str, str]]:
    """(anchor cell, text) of the text shapes in a drawing part (SRC12)."""
    root, out = xml(opened(raw), part), []
    for anchor in root if root is not None else ():
        start = anchor.find(f"{X}from")
        text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for sp in anchor.iter(f"{X}sp") for p in sp.iter(f"{A}p")).strip()
        if start is not None and text:
            out.append((f"{column_name(int(start.find(f'{X}col').text) + 1)}{int(start.find(f'{X}row').text) + 1}", text))
    return out


# PowerPoint


def slide_texts(tree: ET.Element, path: str = "") -> Iterator[tuple[str, str]]:
    """(dotted place, text) of shapes and tables, groups walked in order (SRC13)."""
    nth = 0
    for e in tree:
        if e.tag not in (f"{P}sp", f"{P}grpSp", f"{P}graphicFrame"):
            continue
        nth += 1
        place = f"{path}{nth}"
        if e.tag == f"{P}grpSp":
            yield from slide_texts(e, f"{place}.")
        elif e.tag == f"{P}graphicFrame":
            for table in e.iter(f"{A}tbl"):
                yield place, joined_cells([["".join(t.text or "" for t in tc.iter(f"{A}t")) for tc in tr.findall(f"{A}tc")] for tr in table.iter(f"{A}tr")])
        else:
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in e.iter(f"{A}p")).strip()
            if text:
                yield place, text


def powerpoint(raw: bytes) -> list[Found]:
    package = opened(raw)
    deck, parts = xml(package, "ppt/presentation.xml"), related(package, "ppt/presentation.xml")
    out: list[Found] = []
    for n, slide in enumerate(deck.iter(f"{P}sldId") if deck is not None else (), 1):
        part = parts.get(slide.get(f"{R}id"), "")
        root = xml(package, part)
        tree = root.find(f"{P}cSld/{P}spTree") if root is not None else None
        out += [("slide_text", {"slide": n, "shape": place}, text) for place, text in (slide_texts(tree) if tree is not None else ())]
        for target in related(package, part).values():
            if "/notesSlides/" in f"/{target}":
                notes = xml(package, target)
                lines = ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in notes.iter(f"{A}p")] if notes is not None else []
                text = "\n".join(filter(None, lines)).strip()
                if text:
                    out.append(("slide_notes", {"slide": n}, text))
    return out


def picture_count(raw: bytes, part: str) -> int:
    """Pictures in the drawing of a sheet or slide (SRC12)."""
    package = opened(raw)
    return sum(sum(1 for e in root.iter() if e.tag.endswith("}pic")) for root in (xml(package, p) for p in {part, *related(package, part).values()} if p.endswith(".xml")) if root is not None)


# DXF


def dxf_records(text: str) -> list[tuple[str, str]]:
    """(layer, text) of TEXT, MTEXT and ATTRIB entities, also within inserted blocks, eight deep; dimensions are not read
    (SRC17)."""
    lines = text.splitlines()
    pairs = [(lines[i].strip(), lines[i + 1].strip("\r\n")) for i in range(0, len(lines) - 1, 2)]
    entities: list[dict[str, str]] = []
    blocks: dict[str, list[dict[str, str]]] = {}
    where, block, current = "", "", None
    for code, value in pairs:
        if code == "0":
            current = None
            kind = value.strip()
            if kind in ("SECTION", "ENDSEC"):
                where = "" if kind == "ENDSEC" else where
            elif kind == "BLOCK":
                current, block = {"kind": kind}, ""
            elif kind != "ENDBLK":
                current = {"kind": kind}
                (entities if where == "ENTITIES" else blocks.setdefault(block, [])).append(current)
        elif code == "2" and current is None and value.strip() in ("ENTITIES", "BLOCKS", "HEADER", "TABLES", "OBJECTS", "CLASSES"):
            where = value.strip()
        elif current is not None:
            if current["kind"] == "BLOCK" and code == "2":
                block = value.strip()
            current[code] = current.get(code, "") + value if code == "3" else value

    def read(rows: list[dict[str, str]], depth: int) -> Iterator[tuple[str, str]]:
        for e in rows:
            if e["kind"] in ("TEXT", "MTEXT", "ATTRIB"):
                plain = re.sub(r"\\[A-Za-z][^;\\]*;|[{}]", "", (e.get("3", "") + e.get("1", "")).replace("\\P", "\n")).strip()
                if plain:
                    yield e.get("8", "0"), plain
            elif e["kind"] == "INSERT" and depth < 8:
                yield from read(blocks.get(e.get("2", "").strip(), []), depth + 1)

    return list(read(entities, 0))


def dxf(raw: bytes) -> list[Found]:
    """Records by layer, in batches of at most 12 records and 900 characters (CHK04); bare numbers are left out."""
    layers: dict[str, list[str]] = {}
    for layer, text in dxf_records(raw.decode("utf-8", "replace")):
        if not re.fullmatch(r"[\d.,+\- ]+", text):
            layers.setdefault(layer, []).append(text)
    out: list[Found] = []
    for layer, texts in sorted(layers.items()):
        batch: list[str] = []
        for t in [*texts, None]:
            if t is None or len(batch) >= 12 or sum(map(len, batch)) + len(t) > 900:
                if batch:
                    out.append(("cad_text", {"layer": layer}, "\n".join(batch)))
                batch = []
            if t is not None:
                batch.append(t)
    return out


PARSERS = {"docx": word, "xlsx": excel, "pptx": powerpoint, "dxf": dxf}


def parse(files: DataFrame) -> DataFrame:
    """Chunks of every file that has a parser (SRC01). A file that cannot be read gives one row of kind ``error``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                parser = PARSERS.get(path.rsplit(".", 1)[-1].lower())
                if parser is None:
                    continue
                try:
                    found = parser(bytes(raw))
                except (ValueError, zipfile.BadZipFile, ET.ParseError, KeyError, IndexError) as e:
                    found = [("error", {}, f"{type(e).__name__}: {e}")]
                rows += [(path, n, kind, json.dumps(place, ensure_ascii=False, sort_keys=True), text) for n, (kind, place, text) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "kind", "place", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, ordinal int, kind string, place string, text string")


def statuses(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path``, ``status``: stored_only, failed or ready (SRC01)."""
    n = chunks.groupBy("path").agg(F.count_if(F.col("kind") != "error").alias("n"))
    known = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*PARSERS)
    return files.select("path").join(n, "path", "left").select("path", F.when(~known, "stored_only").when(F.coalesce("n", F.lit(0)) == 0, "failed").otherwise("ready").alias("status"))
