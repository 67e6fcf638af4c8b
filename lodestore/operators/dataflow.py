"""From blocks of files to chunks: sections, tiles, furniture, packing, splitting, page evidence."""

from __future__ import annotations

import re

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import bind
from lodestore.session import lean_batches


#: White space, as a part of a character class: what RE2 takes for it. Java's ``\s`` has the vertical tab besides.
BLANK = r"\t\n\f\r "


def sections(blocks: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """``section``: the last heading up to each block (WIN04, SRC02)."""
    upto = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocks.withColumn("section", F.last_value(heading, ignoreNulls=F.lit(True)).over(upto))


def joined_runs(blocks: DataFrame, key: str, order: str, text: str, short: Column) -> DataFrame:
    """Runs of short blocks as one block at the place of the first (WIN05, SRC03): gaps and islands."""
    by = W.partitionBy(key).orderBy(order)
    starts = F.when(short & F.coalesce(F.lag("_short").over(by), F.lit(False)), 0).otherwise(1)
    marked = blocks.withColumn("_short", short).withColumn("_starts", starts)
    island = F.sum("_starts").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    grouped = marked.withColumn("_island", island).groupBy(key, "_island")
    rows = grouped.agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))
    return rows.drop("_island")


def tiles(rows: DataFrame, key: str, order: str, line: str, size: int = 50) -> DataFrame:
    """Tables in tiles of ``size`` rows; from the second tile on the header row leads again (WIN06, SRC10)."""
    by = W.partitionBy(key).orderBy(order)
    numbered = rows.withColumn("_n", F.row_number().over(by)).withColumn("_header", F.first_value(line).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    body = numbered.withColumn("tile", F.floor((F.col("_n") - 1) / size).cast("long"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line))), lambda x: x[line]), "\n")
    out = body.groupBy(key, "tile").agg(F.min("_n").cast("long").alias("first_row"), F.max("_n").cast("long").alias("last_row"), F.first("_header").alias("_header"), texts.alias("_text"))
    return out.select(key, "tile", "first_row", "last_row", F.when(F.col("tile") > 0, F.concat("_header", F.lit("\n"), "_text")).otherwise(F.col("_text")).alias("text"))


def furniture(lines: DataFrame, group: str, page: str, line: str, share: float = 0.6, least: int = 3, pages: int = 3, longest: int = 120) -> DataFrame:
    """Lines (white space and digits unified) on at least max(least, ceil(share * pages)) pages of their group, of at
    least ``pages`` pages (AGG09). Aggregates only; join against it with left_anti to drop them."""
    total = lines.groupBy(group).agg(F.countDistinct(page).alias("_pages")).filter(F.col("_pages") >= pages)
    found = lines.filter((F.length(line) <= longest) & (F.btrim(line) != "")).groupBy(group, line).agg(F.countDistinct(page).alias("on_pages"))
    return found.join(total, group).filter(F.col("on_pages") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("_pages")))).select(group, line, "on_pages")


# Fixed value: the grammar of a page number, in words or figures, alone on its line.
FOLIO = r"(?i)^[\s\-–—_·/]*(?:第\s*)?(?:page\s*)?[0-9]{1,4}(?:\s*(?:/|of|共)\s*[0-9]{1,4})?\s*(?:页)?[\s\-–—_·/]*$"


def page_furniture(lines: DataFrame, group: str, page: str, line: str, position: str, share: float = 0.6, least: int = 3, pages: int = 3, longest: int = 120, top: float = 0.12, bottom: float = 0.88) -> DataFrame:
    """``group``, ``key``, ``kind`` of the running heads, feet and folios of files (AGG09).

    Only lines in the margins count: their ``position``, the fraction of the page's height, is at most ``top`` or at least
    ``bottom``. ``repeated``: the key, the line without white space, is on at least max(least, ceil(share * pages)) pages of
    a file of ``pages`` or more. ``folio``: page numbers differ from page to page, so their pages are counted together;
    if they are as many, every such line goes. Join on the key of all lines to drop them, also of those in mid-page.
    """
    text = F.regexp_replace(F.col(line), r"\s+", "")
    total = lines.groupBy(group).agg(F.countDistinct(page).alias("_pages")).filter(F.col("_pages") >= pages)
    enough = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("_pages")))
    margin = lines.filter(((F.col(position) <= top) | (F.col(position) >= bottom)) & (F.btrim(line) != ""))
    named = margin.select(group, page, text.alias("key"), F.col(line).rlike(FOLIO).alias("_folio"), F.length(line).alias("_n"))
    repeated = named.filter(~F.col("_folio") & (F.col("_n") <= longest)).groupBy(group, "key").agg(F.countDistinct(page).alias("_on"))
    folios = named.filter("_folio")
    full = folios.groupBy(group).agg(F.countDistinct(page).alias("_on")).join(total, group).filter(F.col("_on") >= enough).select(group)
    first = repeated.join(total, group).filter(F.col("_on") >= enough).select(group, "key", F.lit("repeated").alias("kind"))
    return first.unionByName(folios.join(full, group, "left_semi").select(group, "key", F.lit("folio").alias("kind")).distinct())


_WORD, _WORDS = re.compile(r"\S+", re.ASCII), re.compile(r"\s*\S+\s*\Z|\s*\S+", re.ASCII)


def pack_lines(lines: list[str], budget: int, header: bool = True) -> list[str]:
    """Greedy packing of lines into pieces of at most ``budget`` words: see ``packed``. In time of the text's length."""
    counts = [len(_WORD.findall(t)) for t in lines]
    first = lines[0] if lines else ""
    heads = header and len(lines) > 1 and first != "" and counts[0] <= min(32, budget // 3)
    done: list[str] = []
    parts: list[str] = []  # of the open piece, which is empty until a line is not
    n = 0
    for line, many in zip(lines, counts, strict=True):
        if n + many <= budget:
            if parts or line:
                parts.append(line)
            n += many
            continue
        if parts:
            done.append("\n".join(parts))
        headed = heads and bool(done) and line != first
        head, taken = ([first], counts[0]) if headed else ([], 0)
        room = budget - taken
        if many <= room:
            parts, n = [*head, line], taken + many
        else:
            words, size = _WORDS.findall(line), max(1, room)
            pieces = ["".join(words[i : i + size]) for i in range(0, len(words), size)]
            done += ["\n".join([*head, p]) for p in pieces[:-1]]
            parts, n = [*head, pieces[-1]], taken + (len(words) - 1) % size + 1
    if parts:
        done.append("\n".join(parts))
    return done


def packed(texts: Column, budget: int, header: bool = True) -> Column:
    """Greedy packing of an array of lines into pieces of at most ``budget`` words (CHK02, WIN07).

    A line that does not fit begins a new piece, headed by the first line again if that has at most min(32, budget // 3)
    words. A line of more than the budget is cut into pieces of its own (CHK03). Each piece depends on where the one
    before ended, which in the JVM's array functions means a fold that copies all it has made; so Arrow batches and a loop.
    """

    @F.pandas_udf("array<string>")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda lines: None if lines is None else pack_lines(list(lines), budget, header))

    return run(texts)


def hard_split(text: Column, budget: Column | int) -> Column:
    """Pieces of ``budget`` words, the last one shorter; joined they are the text again (CHK03). One expression finds whole
    pieces: words in an array, cut by a lambda, would be found anew for each piece."""
    most = F.concat(F.lit("{1,"), budget.cast("string"), F.lit("}")) if isinstance(budget, Column) else F.lit(f"{{1,{budget}}}")
    piece = F.concat(F.lit(rf"(?:[{BLANK}]*+[^{BLANK}]++)"), most, F.lit(rf"+(?:[{BLANK}]++\z)?"))
    return bind(F.regexp_extract_all(text, piece, F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array(text)).otherwise(found))


def split_chunks(chunks: DataFrame, limit: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Chunks of more than ``limit`` words in parts (CHK01): the budget is 85 % of the limit, ``part`` counts from 1
    and ``parts`` is their number; other chunks stay, with part and parts null (WIN12)."""
    lean_batches(chunks.sparkSession)
    budget = max(1, min(limit - 1, int(limit * 0.85)))
    n = F.regexp_count(F.col(text), F.lit(r"\S+"))
    long = F.when(n > limit, F.split(text, "\n"))  # null for the others, so only long texts pass through Python
    lines = chunks.select(key, text, packed(long, budget).alias("_packed"))
    out = lines.select(key, F.coalesce("_packed", F.array(text)).alias("_pieces")).filter(F.col(text).isNotNull())
    out = out.select(key, F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("_at", "text"))
    many = F.col("_n") > 1
    return out.select(key, "text", F.when(many, F.col("_at") + 1).cast("long").alias("part"), F.when(many, F.col("_n")).cast("long").alias("parts"))


def batches(values: Column, most: int = 12, chars: int = 900) -> Column:
    """Greedy batches of at most ``most`` values and ``chars`` characters; a longer value is a batch of its own (CHK04)."""
    empty = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("chars"))

    def step(state: Column, value: Column) -> Column:
        full = (F.size(state["open"]) > 0) & ((F.size(state["open"]) >= most) | (state["chars"] + F.length(value) > chars))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(value)).otherwise(F.concat(state["open"], F.array(value))).alias("open"),
            F.when(full, F.length(value)).otherwise(state["chars"] + F.length(value)).alias("chars"),
        )

    state = F.aggregate(values, empty, step)
    return F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])


def column_gaps(boxes: DataFrame, key: list[str], least: float) -> DataFrame:
    """Gaps wider than ``least`` between boxes (x0, x1) of a page: the running greatest right edge against the next left
    one (WIN08)."""
    by = W.partitionBy(*key).orderBy("x0", "x1")
    reach = F.max("x1").over(by.rowsBetween(W.unboundedPreceding, -1))
    return boxes.withColumn("reach", reach).filter(F.col("x0") - F.col("reach") > least).select(*key, F.col("reach").alias("gap_from"), F.col("x0").alias("gap_to"))


def page_evidence(lines: DataFrame, key: list[str], line: str = "line") -> DataFrame:
    """Features of a page and what it is taken for (AGG10): long lines are prose, short ones labels."""
    n = F.length(line)
    return (
        lines.groupBy(*key).agg(
            F.sum(F.when(n >= 65, n).otherwise(0)).cast("long").alias("prose_chars"), F.sum(n).cast("long").alias("chars"),
            F.round(F.avg(F.when(n <= 45, 1.0).otherwise(0.0)), 9).alias("short_share"), F.sum(F.regexp_count(line, F.lit(r"[φ±]|[0-9]+"))).cast("long").alias("readings"),
            F.count(F.lit(1)).alias("lines"),
        ).withColumn("kind", F.when((F.col("prose_chars") >= 180) & (F.col("prose_chars") * 2 >= F.col("chars")), "prose").when((F.col("short_share") >= 0.8) & (F.col("lines") >= 3), "drawing").otherwise("unclear"))
    )


def drawing_prose(text: Column) -> Column:
    """Whether a page's text is prose and so no drawing (VIS05). Words end where no ASCII letter, digit or underscore
    follows: an accented letter ends one."""
    lines = F.split(text, "\n")
    prose = F.aggregate(lines, F.lit(0), lambda s, x: s + F.when(F.length(x) >= 65, F.length(x)).otherwise(0))
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (
        ((prose >= 180) & (prose / F.greatest(F.lit(1), F.length(text)) >= 0.5))
        | ((count("[㐀-鿿]") >= 120) & (count("[。；]") >= 3))
        | ((count(r"(?<![0-9A-Za-z_])[A-Za-z]{3,}(?![0-9A-Za-z_])") >= 30) & (count(rf"[.!?](?=[{BLANK}]|\z)") >= 3))
    )


def box_groups(records: DataFrame, key: list[str]) -> DataFrame:
    """Records by block: union box, least confidence, joined text, and the role of greatest precedence (AGG12)."""
    precedence = F.when(F.col("role") == "identity", 4).when(F.col("role") == "details", 3).when(F.col("role") == "notes", 2).otherwise(1)
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "text")))
    return records.groupBy(*key).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("confidence").alias("confidence"),
        F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"), F.max_by("role", precedence).alias("role"),
    )


def overlap(a: str, b: str) -> Column:
    """Area that boxes with the column prefixes ``a`` and ``b`` share (VEC04)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(f"{a}{hi}", f"{b}{hi}") - F.greatest(f"{a}{lo}", f"{b}{lo}"))
    return side("x0", "x1") * side("y0", "y1")


def contains_box(a: str, b: str) -> Column:
    return (F.col(f"{a}x0") <= F.col(f"{b}x0")) & (F.col(f"{a}y0") <= F.col(f"{b}y0")) & (F.col(f"{a}x1") >= F.col(f"{b}x1")) & (F.col(f"{a}y1") >= F.col(f"{b}y1"))


def tile_grid(width: Column, height: Column, stride: int = 1900, size: int = 2000) -> Column:
    """Overlapping tiles of a page as (x, y, w, h) (VEC05)."""
    starts = lambda n: F.sequence(F.lit(0), F.greatest(F.lit(0), n - (size - stride) - 1), F.lit(stride))
    cells = F.transform(starts(width), lambda x: F.transform(starts(height), lambda y: F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(size), width - x).alias("w"), F.least(F.lit(size), height - y).alias("h"))))
    return F.flatten(cells)


def segments(pages: Column, parts: int = 8) -> Column:
    """Page ranges of max(1, pages // parts) pages (SRC20)."""
    size = F.greatest(F.lit(1), F.floor(pages / parts).cast("int"))
    return F.transform(F.sequence(F.lit(1), pages, size), lambda p: F.struct(p.alias("first"), F.least(pages, p + size - 1).alias("last")))


def table_text(cells: Column) -> Column:
    """Rows of cells: cells joined by bars, rows by line breaks, inner breaks shown as a slash, null cells empty (SRC06)."""
    return F.array_join(F.transform(cells, lambda row: F.array_join(F.transform(row, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" / "))), " | ")), "\n")


def legacy_cell(value: Column, kind: Column) -> Column:
    """Cells of old sheets: whole numbers without ``.0``, dates in ISO form without midnight, booleans in capitals (SRC19)."""
    return F.when(kind == "number", F.regexp_replace(value, r"\.0$", "")).when(kind == "date", F.regexp_replace(value, r"[ T]00:00:00$", "")).when(kind == "bool", F.upper(value)).otherwise(value)


def over_pages(boxes: DataFrame, key: list[str], columns: list[str], work: Callable[[list[tuple]], list[tuple]], out: str) -> DataFrame:
    """``work`` on the rows of each page (tuples of ``columns``), Arrow batch by batch; a page is one row of arrays."""
    import pyarrow as pa

    pages = boxes.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("_rows"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields[:-1])
    names = [x.split()[0] for x in out.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64()}
    kinds = [types[x.split()[1]] for x in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(key))
            flat = list(zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True))
            first, done, ends = lists.offsets[0].as_py(), [], [0]
            bounds = [x - first for x in lists.offsets.to_pylist()]
            for low, high in zip(bounds, bounds[1:]):
                done += work(flat[low:high])
                ends.append(len(done))
            columns_ = zip(*done, strict=True) if done else ([] for _ in names)
            rows = pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns_, kinds, strict=True)], names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=[*batch.schema.names[: len(key)], "_done"])

    fields = ", ".join(f"{x.split()[0]}:{x.split()[1].replace('long', 'bigint')}" for x in out.split(", "))
    return pages.mapInArrow(run, f"{kept}, _done array<struct<{fields}>>").select(*key, F.inline("_done"))


def merge_touching(boxes: DataFrame, key: list[str]) -> DataFrame:
    """Boxes that touch merged to their union until none touch (JOI13): a fixpoint over the few boxes of a page."""

    def work(rows: list[tuple]) -> list[tuple]:
        rest, merged = sorted(rows), True
        while merged:
            merged, out = False, []
            for box in rest:
                for k, b in enumerate(out):
                    if box[0] <= b[2] and b[0] <= box[2] and box[1] <= b[3] and b[1] <= box[3]:
                        out[k] = (min(b[0], box[0]), min(b[1], box[1]), max(b[2], box[2]), max(b[3], box[3]))
                        merged = True
                        break
                else:
                    out.append(box)
            rest = sorted(out)
        return rest

    sides = ["x0", "y0", "x1", "y1"]
    return over_pages(boxes.select(*key, *(F.col(c).cast("double") for c in sides)), key, sides, work, "x0 double, y0 double, x1 double, y1 double")


def reading_order(boxes: DataFrame, key: list[str], width: float, height: float) -> DataFrame:
    """``place`` of each box (id, x0, y0, x1, y1) of a page by recursive cuts (ORD10): at vertical gaps of more than
    max(14, 2 % of the width) first, then at horizontal ones of more than max(10, 1.5 % of the height), eight deep."""
    across, down = max(14.0, 0.02 * width), max(10.0, 0.015 * height)

    def cut(rows: list, low: int, high: int, gap: float) -> list[list]:
        parts, reach = [], None
        for row in sorted(rows, key=lambda r: (r[low], r[high])):
            if reach is None or row[low] - reach > gap:
                parts.append([])
            parts[-1].append(row)
            reach = row[high] if reach is None else max(reach, row[high])
        return parts

    def order(rows: list, depth: int) -> list:
        if depth < 8 and len(rows) > 1:
            for low, high, gap in ((1, 3, across), (2, 4, down)):
                parts = cut(rows, low, high, gap)
                if len(parts) > 1:
                    return [r for part in parts for r in order(part, depth + 1)]
        return sorted(rows, key=lambda r: (r[2], r[1], r[0]))

    work = lambda rows: [(r[0], k + 1) for k, r in enumerate(order(rows, 0))]
    return over_pages(boxes, key, ["id", "x0", "y0", "x1", "y1"], work, "id long, place long")
