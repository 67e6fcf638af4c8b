"""Sharding with sampled splitters; DataFrame operations only.

Law ``bytes``: shards hold nearly equal bytes. Rows are ordered by a hash of their text, so that equal texts
stand together, and dealt in ranges:

1. A size-weighted sample of keys (``draws`` a range, so at most about ``n_shards * ranges * draws`` keys)
   gives quantile boundaries, ``ranges`` ranges to a shard.
2. Every range is measured over all rows. A range of more than twice its share is subdivided at quantiles of a
   denser sample of its own keys, and measured again, until none is left. A text whose copies alone exceed a
   range's share gets ranges of its own, dealt by row. So no window below sees more than about two shares,
   however many copies a text has.
3. Ranges go to shards by their exact bytes. All copies of a text stay in one shard if they fit into one; only a
   text of more bytes than a shard's share is cut into its ranges. Large texts go first, each to the emptiest
   shard; the ranges of the others fill up what is left.

What the driver sees is bounded by the parameters alone: the sample, the ranges, the texts larger than a range.
"""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore.llm.common import materialize, settled, text_or_empty

#: Rows of at least this size count for balance even if the text is empty.
OVERHEAD = 16


@settled
def shard(docs: DataFrame, n_shards: int = 40, ranges: int = 64, draws: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``size`` (UTF-8 bytes of the text, null: none, plus 16), ``text_crc32`` (null: 0), ``law``,
    ``shard``, ``slot`` (gapless from 0 in each shard) and ``grown_shard`` (null: this law does not keep rows in place).

    Ties (repeated rows) get neighbouring slots in any order. Null and empty texts are two texts of 16 bytes a row. A
    null id is an id like another. With fewer texts than shards some shards stay empty.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    # The number of a row tells copies apart that share id and text; it is fixed, since the rows are written once.
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text_or_empty(text).cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1.0, total / n_shards)
    per_range = max(1.0, share / ranges)

    # Texts whose copies exceed a range: at most n_shards * ranges of them.
    heavy = {r["h"]: r["bytes"] for r in rows.groupBy("h").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > per_range).collect()}
    ways = {h: math.ceil(b / per_range) for h, b in heavy.items()}
    heavy_df = F.broadcast(spark.createDataFrame([(h, i, ways[h]) for i, h in enumerate(sorted(heavy))], "h long, heavy int, ways int"))
    rows = rows.join(heavy_df, "h", "left")

    # Boundaries of the other ranges from a size-weighted sample, denser ones where a range is too large.
    step = max(1.0, per_range / draws)
    light = rows.filter(F.col("heavy").isNull())
    splitters = _quantiles(light, step, draws, "draw")
    ranged, measured = None, []
    for nth in range(1, 64):
        ranged = _with_range(rows, splitters)
        measured = _measure(ranged)
        over = [r["unit"] for r in measured if not r["heavy"] and r["bytes"] > 2 * per_range]
        if not over:
            break
        inside = ranged.filter(F.col("unit").isin(over))
        new = _quantiles(inside, max(1.0, step / 2**nth), max(1, draws * 2**nth // 2), f"draw{nth}", "unit")
        if set(new) <= set(splitters) and step <= 2**nth:
            break  # every key of the range is a boundary
        splitters = sorted({*splitters, *new})
    rows = ranged

    plan = _place(measured, {i: heavy[h] for i, h in enumerate(sorted(heavy))}, n_shards, share)
    plan_df = F.broadcast(spark.createDataFrame(plan, T.StructType.fromDDL("unit string, first_shard int, bytes_before double, bounds array<double>, rows_before long, slot_base long")))
    in_unit = W.partitionBy("unit")
    to_row = rows.join(plan_df, "unit")
    upto_text = F.sum("size").over(in_unit.orderBy("h").rangeBetween(W.unboundedPreceding, W.currentRow))
    nth = F.row_number().over(in_unit.orderBy("h", "doc_id")) - 1
    placed = to_row.select(
        "doc_id", "size", "text_crc32", "slot_base", "rows_before", nth.alias("nth"), "first_shard",
        F.size(F.filter("bounds", lambda b: b < F.col("bytes_before") + upto_text)).alias("step"),
    )
    placed = materialize(
        placed.select("doc_id", "size", "text_crc32", (F.col("first_shard") + F.col("step")).cast("int").alias("shard"), "slot_base", (F.col("rows_before") + F.col("nth")).cast("long").alias("rank")),
        "shard-placed",
    )
    # Light rows follow the heavy ones of their shard, in the order of ranges. At most n_shards rows.
    starts = F.broadcast(placed.filter("slot_base is null").groupBy("shard").agg(F.min("rank").alias("start")))
    held, n_rows = {}, {r["unit"]: r["rows"] for r in measured}
    for unit in plan:
        if unit[5] is not None:
            held[unit[1]] = max(held.get(unit[1], 0), unit[5] + n_rows[unit[0]])
    held_df = F.broadcast(spark.createDataFrame(list(held.items()), "shard int, held long"))
    slot = F.when(F.col("slot_base").isNotNull(), F.col("slot_base") + F.col("rank")).otherwise(F.col("rank") - F.col("start") + F.coalesce("held", F.lit(0)))
    return placed.join(starts, "shard", "left").join(held_df, "shard", "left").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _quantiles(rows: DataFrame, step: float, every: int, salt: str, group: str | None = None) -> list[int]:
    """Every ``every``-th of the keys of a sample in which a row comes about once for each ``step`` bytes, in order
    (of each ``group`` by itself)."""
    chance = F.pmod(F.xxhash64("h", "row", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select((F.col(group) if group else F.lit("")).alias("g"), "h", F.floor(F.col("size") / step + chance).cast("long").alias("n")).filter("n > 0")
    found, seen, of = [], 0, None
    for g, h, n in sorted((r["g"], r["h"], r["n"]) for r in drawn.groupBy("g", "h").agg(F.sum("n").alias("n")).collect()):
        seen = 0 if g != of else seen
        of = g
        if (seen + n) // every > seen // every:
            found.append(h)
        seen += n
    return sorted(set(found))


def _with_range(rows: DataFrame, splitters: list[int]) -> DataFrame:
    """``unit``: the range of each row, found in two steps: the key's leading bits, then the few splitters that share them."""
    spark = rows.sparkSession
    leading = lambda h: h >> 54
    table = [
        (b, bisect.bisect_left(splitters, b << 54), [s for s in splitters[bisect.bisect_left(splitters, b << 54) : bisect.bisect_left(splitters, (b + 1) << 54)]])
        for b in range(leading(-(1 << 63)), leading((1 << 63) - 1) + 1)
    ]
    table_df = F.broadcast(spark.createDataFrame(table, "bits long, below int, near array<long>"))
    nth = F.col("below") + F.size(F.filter("near", lambda s: s <= F.col("h")))
    salt = F.pmod(F.xxhash64("row", F.lit("salt")), F.col("ways"))
    return rows.join(table_df, F.shiftright("h", 54) == F.col("bits")).select(
        "row", "doc_id", "size", "text_crc32", "h",
        F.when(F.col("heavy").isNull(), F.concat(F.lit("r"), nth)).otherwise(F.concat_ws(".", F.concat(F.lit("t"), F.col("heavy")), salt)).alias("unit"),
    )


def _measure(rows: DataFrame) -> list:
    """Exact bytes and rows of every range."""
    found = rows.groupBy("unit").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return sorted(found.select("*", F.col("unit").startswith("t").alias("heavy")).collect(), key=lambda r: r["unit"])


def _place(measured: list, heavy: dict[int, int], n_shards: int, share: float) -> list[tuple]:
    """For each range its (first) shard. Texts that fit into a shard first, largest first, each to the emptiest shard,
    then the ranges of those that do not, and at last the ranges of all others fill up the shards in order."""
    load, rows = [0.0] * n_shards, [0] * n_shards
    plan: list[tuple] = []
    queue = [(0.0, s) for s in range(n_shards)]

    def put(unit, s: int) -> None:
        plan.append((unit["unit"], s, 0.0, [], 0, rows[s]))
        rows[s] += unit["rows"]

    parts: dict[int, list] = {}
    for unit in measured:
        if unit["heavy"]:
            parts.setdefault(int(unit["unit"][1:].split(".")[0]), []).append(unit)
    cut = [unit for i in parts if heavy[i] > share for unit in parts[i]]
    for i in sorted((i for i in parts if heavy[i] <= share), key=lambda i: (-heavy[i], i)):
        held, s = heapq.heappop(queue)
        for unit in parts[i]:
            put(unit, s)
        load[s] = held + heavy[i]
        heapq.heappush(queue, (load[s], s))
    for unit in sorted(cut, key=lambda u: (-u["bytes"], u["unit"])):
        held, s = heapq.heappop(queue)
        put(unit, s)
        load[s] = held + unit["bytes"]
        heapq.heappush(queue, (load[s], s))

    light = [unit for unit in measured if not unit["heavy"]]
    room = [max(0.0, share - x) for x in load]
    whole, bytes_light = sum(room) or 1.0, sum(unit["bytes"] for unit in light)
    ends, at = [], 0.0
    for x in room[:-1]:
        at += x / whole * bytes_light
        ends.append(at)
    before, n = 0, 0
    for unit in light:
        first = bisect.bisect_left(ends, before)
        last = bisect.bisect_left(ends, before + unit["bytes"])
        plan.append((unit["unit"], first, float(before), ends[first:last], n, None))
        before, n = before + unit["bytes"], n + unit["rows"]
    return plan
