"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Its sketch holds ``bands * rows`` registers, each the least of an
exponential variable over the set, on a geometric scale (base ``BASE``) and truncated to 16 bits: mergeable by
the greater value, and equal in two sketches with about the probability of the Jaccard similarity. Bands of
registers give candidates, the joint maximum likelihood of a pair's registers (sizes being known) drops the
hopeless ones, and the rest is confirmed on the full sets.

Scale. Equal sets are one node from the start, found by an aggregate. Then rounds: in a bucket of several
components, every member outside its largest one meets one member of that, another one each round; of those that
a document meets, the one that it meets in most buckets is tried. Rounds go on while they link a fair share of what
is left; they join the bulk of a group of copies at a cost in proportion to its size. At last, of the buckets that
still hold several components, the documents outside the largest one are held against all others: in small buckets
pair by pair, in others block by block, on whole sets, so that only links leave a block and never its pairs. Pairs
within a component add nothing, so no link between components is lost. Components come from joins and aggregates
whose large side can be split; rounds are written to the shared folder. Few documents share a bucket: bands, registers and
texts are chosen by broadcast bits of those that do before they are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import bucketed, fresh, lean_batches, materialize, settled, text_or_empty, worker_state
from lodestore.llm.words import find_words, mix, shingles, text_chunks, word_hashes

BASE, RATE, TOP = 1.001, 20.0, 65535
#: A pair estimated this much below the threshold is dropped: over five standard deviations of 200 registers.
MARGIN = 0.15
#: A further round follows one that linked at least this share of the documents it met.
FAIR = 0.05
#: Buckets of at most so many rows meet pair by pair; others in blocks of so many rows.
FEW, BLOCK = 16, 2048
#: Bits for each key by which rows are chosen before a join, and their greatest number as a power of 2: 16 MB of words.
SPARSE, BITS = 16, 26


class Sketcher:
    def __init__(self, registers: int):
        rng = np.random.default_rng(10)
        self.factors = (rng.integers(0, 1 << 32, registers, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.terms = rng.integers(0, 1 << 32, registers, dtype=np.uint64).astype(np.uint32)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """Of a set given by distinct 64-bit hashes. Empty sets have registers of 0."""
        if not len(hashes):
            return np.zeros(len(self.factors), np.uint16)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factors), (1 << 32) - 1, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(least, (x[at : at + 2048, None] * self.factors + self.terms).min(0), out=least)
        drawn = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        return np.clip(np.floor(1 - np.log(drawn) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs of sketches (rows) of maximum joint likelihood, the sizes being known."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    log_b = np.log(BASE)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left, right = low + third, high - third
        rises = likelihood(left) < likelihood(right)
        low, high = np.where(rises, left, low), np.where(rises, high, right)
    return (low + high) / 2


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for _, data, offsets in text_chunks(column):
        starts, ends, first = find_words(data, offsets)
        found, before = shingles(word_hashes(data, starts, ends, True), first, width)
        for i in range(len(before) - 1):
            yield np.unique(found[before[i] : before[i + 1]])


def sketches(docs: DataFrame, width: int = 5, registers: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``t`` (a hash of the text), ``n_shingles``, ``key1`` and ``key2`` (equal for equal sets),
    ``registers`` (16-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("sketcher", lambda: Sketcher(registers), registers)
        for batch in batches:
            n, key1, key2, found = [], [], [], []
            for s in _sets(batch.column(2), width):
                n.append(len(s))
                key1.append(int(mix(s + np.uint64(1)).sum(dtype=np.uint64)))
                key2.append(int(mix(s + np.uint64(2)).sum(dtype=np.uint64)))
                found.append(own.registers(s).astype("<u2").tobytes())
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), signed(key1), signed(key2), pa.array(found, pa.binary())], names=["id", "t", "n_shingles", "key1", "key2", "registers"])

    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), text_or_empty(F.col(text_col)).alias("_text"))
    return lean_batches(cols).mapInArrow(run, "id long, t long, n_shingles long, key1 long, key2 long, registers binary")


def _estimated(pairs: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose estimated similarity is at least ``least``, with it (``similar``)."""
    one = lambda c: sketched.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                array = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)  # noqa: B023, E731
                number = lambda k: batch.column(k).to_numpy().astype(float)  # noqa: B023, E731
                similar = estimate(array(3), array(5), number(2), number(4))
                found = pa.array(similar >= least)
                yield pa.RecordBatch.from_arrays([x.filter(found) for x in (batch.column(0), batch.column(1), pa.array(similar, pa.float64()))], names=["a", "b", "similar"])

    met = pairs.join(one("a"), "a").join(one("b"), "b")
    return met.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(run, "a long, b long, similar double")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) with share[1] * shared >= share[0] * all shingles, on full sets.

    ``texts`` lies in buckets of its ids, so only the texts of b travel, once, and those of the distinct a. These two sides
    have plain exchanges, since many pairs may have the same a.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(_sets(batch.column(2), width), _sets(batch.column(3), width), strict=True):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(len(x) > 0 and share[1] * shared >= share[0] * (len(x) + len(y) - shared))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t_{c}"))
    pairs = materialize(pairs.select("a", "b"), "estimated")
    asked = materialize(one("a").join(pairs.select("a").distinct(), "a", "left_semi"), "asked")
    met = pairs.join(one("b"), "b").join(asked, "a")
    return met.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (least id that is reachable) of every id of the edges (a, b).

    Each round every id takes the least label of its neighbours and then that label's own label.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(now, both["b"] == now["id"]).select(both["a"].alias("id"), "component")
        least = materialize(near.unionByName(now).groupBy("id").agg(F.min("component").alias("component")), "labels")
        up = least.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        jumped = materialize(least.join(up, "component", "left").select("id", F.coalesce("upper", "component").alias("component")), "labels")
        changed = jumped.join(now.withColumnRenamed("component", "before"), "id").filter("component <> before").limit(1).count()
        now = jumped
        if not changed:
            return now


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, component) after the components that the edges connect are one."""
    one = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    between = edges.join(one("a"), "a").join(one("b"), "b").filter("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    merged = components(between).select(F.col("id").alias("component"), F.col("component").alias("into"))
    return materialize(labels.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component")), "labels")


def _pairs(open_: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of different components in the same bucket; for buckets of few rows."""
    one = lambda c: [F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("component").alias(f"c_{c}")]
    met = open_.filter("component <> largest").select("bucket", *one("a")).join(open_.select("bucket", *one("b")), "bucket")
    met = met.filter((F.col("c_a") != F.col("c_b")) & (share[1] * F.least("n_a", "n_b") >= share[0] * F.greatest("n_a", "n_b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _whole_sets(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``id`` and ``tokens``, the 64-bit hashes of all shingles, of the given nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in _sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "tokens"])

    return texts.join(nodes.select("id").distinct(), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, tokens array<long>")


def _block_links(open_: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between components of a bucket, by blocks: of each document outside the largest component one link
    to each other component of the block. Blocks hold ``BLOCK`` rows of either side at most, about."""

    def meet(block: pa.Table) -> pa.Table:
        ids, component = block["id"].to_numpy(), block["component"].to_numpy()
        flat, at = block["tokens"].combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(block["tokens"]).to_numpy())])
        tokens = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        size = np.array([len(t) for t in tokens])
        asks = np.flatnonzero(block["side"].to_numpy() == 0)
        answers = np.flatnonzero((block["side"].to_numpy() == 1) & (size > 0))
        a, b = [], []
        if len(asks) and len(answers):
            known, place = np.unique(np.concatenate(tokens), return_inverse=True)
            place = np.split(place, np.cumsum(size)[:-1])
            flat, starts = np.concatenate([place[i] for i in answers]), np.cumsum(size[answers]) - size[answers]
            flag = np.zeros(len(known), dtype=np.int32)
            for i in asks:
                flag[place[i]] = 1
                shared = np.add.reduceat(flag[flat], starts)
                flag[place[i]] = 0
                hit = (share[1] * shared >= share[0] * (size[i] + size[answers] - shared)) & (component[answers] != component[i]) & (shared > 0)
                _, once = np.unique(component[answers[hit]], return_index=True)
                for j in answers[hit][once]:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    own, every = F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    entry = lambda side, ask, answer: F.struct(F.lit(side).alias("side"), ask.alias("ask"), answer.alias("answer"))
    answers, asks = F.transform(every, lambda k: entry(1, k, own)), F.transform(every, lambda k: entry(0, own, k))
    entries = F.when(F.col("component") != F.col("largest"), F.concat(answers, asks)).otherwise(answers)
    dealt = open_.withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("long")).select("bucket", "id", "component", F.explode(entries).alias("e")).join(sets, "id")
    dealt = dealt.select("bucket", F.col("e.ask").alias("ask"), F.col("e.answer").alias("answer"), F.col("e.side").alias("side"), "id", "component", "tokens")
    return dealt.groupBy("bucket", "ask", "answer").applyInArrow(meet, "a long, b long").distinct()


def _several_components(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (``bucket``, ``id``, ``n``, ``times``) of buckets of several components, with their ``component``, the
    ``largest`` one of the bucket and its number of ``rows``. ``times``: of how many buckets it is one."""
    named = open_.select("bucket", "id", "n", "times").join(labels, "id")
    parts = named.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("count").alias("rows"))
    return materialize(named.join(parts.filter("parts > 1"), "bucket").drop("parts"), "open")


def _told(rows: DataFrame, keys: DataFrame, *of: str) -> tuple[DataFrame, Column]:
    """``rows`` with further columns, and a condition on them: true for the rows whose columns ``of`` are those of a row of
    ``keys`` and for about one in ``SPARSE`` of the others, else false. The bits of all keys, at most ``1 << BITS``, are
    broadcast in words of 64; more keys make it true for more of the others."""
    at, word, set_at, set_word, set_bits = fresh(rows, "_at", "_word", "_set_at", "_set_word", "_set_bits")
    bits = 1 << max(6, min(BITS, (SPARSE * keys.count()).bit_length()))
    place = F.xxhash64(*of).bitwiseAND(bits - 1)
    words = keys.select(place.alias(set_at)).groupBy(F.shiftright(set_at, 6).alias(set_word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({set_at} & 63 as int)))").alias(set_bits))
    met = rows.withColumn(at, place).withColumn(word, F.shiftright(at, 6)).join(F.broadcast(words), F.col(word) == F.col(set_word), "left")
    return met, F.expr(f"coalesce(getbit({set_bits}, cast({at} & 63 as int)) = 1, false)")


def _among(rows: DataFrame, keys: DataFrame, *of: str) -> DataFrame:
    """The rows that ``_told`` tells: a join with ``keys`` that follows moves hardly more than it finds."""
    met, told = _told(rows, keys, *of)
    return met.filter(told).select(*rows.columns)


def _judged(docs: DataFrame, width: int, share: tuple[int, int], bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: ``id``, ``t`` (hash of its text), ``n_shingles``, ``component_id`` (null: has no id or no words) and
    ``least`` (whether its id and text hash are the least of its component)."""
    sketched = materialize(sketches(docs, width, bands * rows, id_col, text_col), "sketches")
    full = sketched.filter("n_shingles > 0 and id is not null")
    keys = ["key1", "key2", "n_shingles"]
    nodes = full.groupBy(*keys).agg(F.min(F.struct("id", "t")).alias("first"), F.first("registers").alias("registers"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("id"), *keys, "first", "registers"), "nodes")

    part = lambda k: F.xxhash64(F.substring(F.col("registers"), 2 * rows * k + 1, 2 * rows), F.lit(k))
    banded = nodes.select("id", F.col("n_shingles").alias("n"), F.explode(F.array(*(part(k) for k in range(bands)))).alias("bucket"))
    several = banded.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    several = materialize(several.select("bucket"), "several")  # then the join deals both sides anew, and a large bucket can be split
    shared = materialize(_among(banded, several, "bucket").join(several, "bucket"), "shared")
    # of buckets with the same members one stands for all: near copies share most of their bands
    members = [F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("rows"), F.expr("bit_xor(xxhash64(id))").alias("one"), F.expr("bit_xor(xxhash64(id, 1))").alias("two")]
    groups = shared.groupBy("bucket").agg(*members).groupBy("first", "last", "rows", "one", "two").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times"))
    open_ = materialize(shared.join(materialize(groups.select("bucket", "times"), "groups"), "bucket"), "buckets")
    labels = materialize(open_.select("id").distinct().select("id", F.col("id").alias("component")), "labels")
    near = materialize(_among(nodes, labels, "id").join(labels.select("id"), "id", "left_semi"), "near")
    wanted = near.select(F.col("id").alias("node"), F.col("first.id").alias("id"), F.col("first.t").alias("t"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), text_or_empty(F.col(text_col)).alias("text"))
    texts = _among(texts, wanted, "id", "t").join(wanted, ["id", "t"])
    texts = bucketed(texts.groupBy(F.col("node").alias("id")).agg(F.first("text").alias("text")), "texts", "id")
    least, alike = share[0] / share[1] - MARGIN, share[1] * F.least("n_a", "n_b") >= share[0] * F.greatest("n_a", "n_b")

    nth, going = 0, True
    while going:
        nth += 1
        open_ = _several_components(open_, labels)
        inside = open_.filter("component = largest").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket", F.lit(nth)).alias("drawn"), "id", "n")).alias("x"))
        met = open_.filter("component <> largest").select("bucket", "times", F.col("id").alias("b"), F.col("n").alias("n_b"))
        met = met.join(inside.select("bucket", F.col("x.id").alias("a"), F.col("x.n").alias("n_a")), "bucket").filter(alike)
        best = met.groupBy("b", "a").agg(F.sum("times").alias("count")).groupBy("b").agg(F.max(F.struct("count", "a"))["a"].alias("a"))
        linked = materialize(_confirmed(_estimated(best.select("a", "b"), near, least), texts, width, share), "linked")
        going = linked.count() >= FAIR * max(1, open_.filter("component <> largest").select("id").distinct().count())
        labels = _joined(labels, linked)

    open_ = _several_components(open_, labels)
    large = open_.filter(F.col("rows") > FEW)
    sets = materialize(_whole_sets(large, texts, width), "sets")
    pairs = _estimated(_pairs(open_.filter(F.col("rows") <= FEW), share), near, least).select("a", "b")
    crossing = materialize(pairs.unionByName(_block_links(large, sets, share)).distinct(), "crossing")
    labels = _joined(labels, materialize(_confirmed(crossing, texts, width, share), "linked"))

    placed = nodes.select(*keys, "id", "first").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    heads = placed.groupBy("component").agg(F.min("first").alias("head"))
    of_set = placed.select(*keys, "component").join(heads, "component").select(*keys, "head")
    found = sketched.filter("n_shingles > 0 and id is not null").select("id", "t", *keys).join(of_set, keys)
    judged = found.select("id", "t", "n_shingles", F.col("head.id").alias("component_id"), (F.struct("id", "t") == F.col("head")).alias("least"))
    rest = sketched.filter("n_shingles = 0 or id is null").select("id", "t", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("least"))
    return judged.unionByName(rest)


@settled
def near_duplicates(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``n_shingles`` (size of its set), ``component_id`` (least id that links reach) and ``kept`` (the id is
    its component's). Two documents are linked if share[1] * shared >= share[0] * all shingles of both.

    ``width`` words make a shingle; a text with fewer words is one shingle, one without words (null, empty, blank) is
    linked with nothing. A row is judged by its own text, so rows that repeat an id with other texts may differ in
    component; repeated rows agree. Rows with a null id are kept and have a null component.
    """
    judged = _judged(docs, width, share, bands, rows, id_col, text_col)
    component = F.coalesce("component_id", "id")
    return judged.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays for each component of ``near_duplicates``: that of the
    least id, and among texts of this id that of the least hash.

    Every row is judged by its own text, so of rows that repeat an id only the copies go. Rows equal in id and text
    become one, with the other columns of the least of them in JSON. Rows without an id or without words are linked
    with nothing: they stay, but for such repetitions.
    """
    judged = _judged(docs, width, share, bands, rows, id_col, text_col)
    known, t, of_id, of_t, verdict = fresh(docs, "_nd_id", "_nd_t", "_nd_of_id", "_nd_of_t", "_nd_verdict")
    several = judged.groupBy("id", "t").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).filter("n > 1 or not least")
    several = materialize(several.select(F.col("id").alias(of_id), F.col("t").alias(of_t), F.when(F.col("least"), "one").otherwise("none").alias(verdict)), "verdicts")
    keyed = docs.select("*", F.col(id_col).cast("long").alias(known), F.xxhash64(text_col).alias(t))
    same = F.col(known).eqNullSafe(F.col(of_id)) & (F.col(t) == F.col(of_t))
    # most rows have no verdict: only those that may have one are moved to meet it
    verdicts = several.select(F.col(of_id).alias(known), F.col(of_t).alias(t), verdict)
    met, told = _told(keyed, verdicts, known, t)
    single = met.filter(~told).select(*docs.columns).unionByName(met.filter(told).select(*keyed.columns).join(several, same, "left_anti").select(*docs.columns))
    repeated = _among(keyed, verdicts.filter(F.col(verdict) == "one"), known, t).join(several.filter(F.col(verdict) == "one"), same).groupBy(known, t)
    row = F.struct(*docs.columns)
    return single.unionByName(repeated.agg(F.min_by(row, F.to_json(row)).alias(verdict)).select(F.inline(F.array(verdict))))


#: The same for two-word shingles in DuckDB: all pairs that share a shingle, and everything that links reach.
SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM {docs}),
sets AS (SELECT doc_id, CASE WHEN len(words) >= 2 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) WHEN len(words) = 1 THEN words ELSE [] END AS s FROM worded),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) c ON s.doc_id = c.a
"""
