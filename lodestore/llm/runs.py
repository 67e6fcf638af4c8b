"""Periodic runs of words, found in a grammar of the texts.

The words of a batch of texts become numbers, and Re-Pair replaces pairs that occur again by new symbols, frequent
ones first: in falling tiers of frequency, each until no pair of it is left, many pairs at a time. What stays of a
text is joined by a balanced tree. Every run lies in the expansion of some symbol or node and crosses the boundary
between its two halves, so runs are looked for once a symbol, around that boundary, and carried to all places that
derive from it. Of stretches with the same period those inside a larger one go, and of periods with the same stretch
all but the smallest. At the end the words of every run are compared themselves.

Nothing is shuffled: a text is a row, and memory is bounded by an Arrow batch or the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import lean_batches, text_or_empty
from lodestore.llm.words import mix

#: A run has at least so many words, and so many times its period.
SHORTEST, TIMES = 6, 4
#: Frequencies down to which pairs are replaced, in this order.
TIERS = (1024, 64, 8, 2)
#: (node, period) pairs looked at together.
SLICE = 1 << 22
PRIMES = ((1 << 31) - 1, (1 << 31) - 19)


class Grammar:
    """Re-Pair over numbered words; ``first`` has the start of each text and the end of the last.

    ``left``, ``right``: symbols of a rule; ``start``, ``mid``, ``end``: a place where it stands. Rule r is the symbol
    ``terminals`` + r, and a rule refers to earlier ones only. ``symbols`` and ``places``: what is left of the texts.
    """

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.terminals = int(words.max(initial=-1)) + 1
        self.symbols, self.places = words.astype(np.int64), np.arange(len(words))
        self.joined = np.ones(len(words), bool)  # with the next symbol, in the same text
        self.joined[first[1:][first[1:] > 0] - 1] = False
        self.most = np.full(len(words), len(words), np.int32)  # as often at most the pair that begins here stands
        self.n = len(words)
        self.rules: list[tuple[np.ndarray, ...]] = []
        self.made = 0
        for least in TIERS:
            while self._replace(least):
                pass
        self.left, self.right, self.start, self.mid, self.end = (np.concatenate([r[i] for r in self.rules]) if self.rules else np.zeros(0, np.int64) for i in range(5))

    def _often(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``symbols`` of pairs that stand at least ``least`` times, and the pairs.

        All places of a pair arise in the round that makes its newer symbol, so a pair once too rare stays so.
        """
        at = np.flatnonzero(self.joined & (self.most >= least))
        pairs = (self.symbols[at] << 32) | self.symbols[at + 1]
        bits = max(10, min(24, int(len(at)).bit_length() + 1))
        slot = (mix(pairs.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        many = np.bincount(slot, minlength=1 << bits)[slot]  # a slot holds a pair and sometimes others
        self.most[at] = many
        at, pairs = at[many >= least], pairs[many >= least]
        order = np.sort(pairs)
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        kept = order[edge[:-1]][np.diff(edge) >= least]
        if not len(kept):
            self.most[at] = np.minimum(self.most[at], least - 1)
            return at[:0], pairs[:0]
        often = kept[np.minimum(np.searchsorted(kept, pairs), len(kept) - 1)] == pairs
        self.most[at[~often]] = np.minimum(self.most[at[~often]], least - 1)
        return at[often], pairs[often]

    def _replace(self, least: int) -> bool:
        """Replace pairs that do not overlap: of overlapping ones those of greater hash, of equal ones every second."""
        if len(self.symbols) < 2:
            return False
        at, pairs = self._often(least)
        if not len(at):
            return False
        chained = np.concatenate([[False], (np.diff(at) == 1) & (pairs[1:] == pairs[:-1])])
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        at, pairs = at[since % 2 == 0], pairs[since % 2 == 0]
        weight, touching = mix(pairs.view(np.uint64)), np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~touching | (weight[1:] > weight[:-1])
        wins[:-1] &= ~touching | (weight[:-1] > weight[1:])
        at, pairs = at[wins], pairs[wins]
        new, one, which = np.unique(pairs, return_index=True, return_inverse=True)
        ends = np.append(self.places[1:], self.n)
        self.rules.append((new >> 32, new & 0xFFFFFFFF, self.places[at[one]], self.places[at[one] + 1], ends[at[one] + 1]))
        self.symbols[at] = self.terminals + self.made + which
        self.made += len(new)
        self.joined[at] = self.joined[at + 1]
        self.most[at] = self.most[np.maximum(at - 1, 0)] = self.n
        stays = np.ones(len(self.symbols), bool)
        stays[at + 1] = False
        self.symbols, self.places, self.joined, self.most = self.symbols[stays], self.places[stays], self.joined[stays], self.most[stays]
        return True

    def tree(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Nodes (start, mid, end) above what is left of each text, level by level."""
        places, joined = self.places, self.joined
        while joined.any():
            ends, n = np.append(places[1:], self.n), np.arange(len(places))
            opens = np.concatenate([[True], ~joined[:-1]])
            nth = n - np.maximum.accumulate(np.where(opens, n, 0))
            at = np.flatnonzero((nth % 2 == 0) & joined)
            yield places[at], places[at + 1], ends[at + 1]
            stays = np.ones(len(places), bool)
            stays[at + 1] = False
            joined = joined.copy()
            joined[at] = joined[at + 1]
            places, joined = places[stays], joined[stays]

    def derived(self, rule: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Stretches found at the place of a rule, at all places that derive from it."""
        order = np.argsort(rule, kind="stable")
        rule, start, end, period = rule[order], start[order], end[order], period[order]
        first = np.searchsorted(rule, np.arange(self.made + 1))
        own = np.diff(first)
        bears = np.zeros(self.terminals + self.made, bool)
        bears[self.terminals :] = own > 0
        done = 0
        for r in self.rules:
            n = len(r[0])
            bears[self.terminals + done : self.terminals + done + n] |= bears[r[0]] | bears[r[1]]
            done += n
        at = np.flatnonzero(bears[self.symbols])
        symbol, place = self.symbols[at] - self.terminals, self.places[at]
        while len(symbol):
            many = own[symbol]
            item = np.repeat(first[symbol] - np.cumsum(many) + many, many) + np.arange(many.sum())
            shift = np.repeat(place - self.start[symbol], many)
            yield start[item] + shift, end[item] + shift, period[item]
            below = np.concatenate([self.left[symbol], self.right[symbol]])
            place = np.concatenate([place, place + self.mid[symbol] - self.start[symbol]])
            lives = bears[below]
            symbol, place = below[lives] - self.terminals, place[lives]


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * step % prime])
        step = step * step % prime
    return out[:n]


class Equal:
    """Are two stretches of words equal? By hashes modulo two primes, of numbers drawn by a seed."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.n, self.parts = len(words), []
        for p in PRIMES:
            values = rng.integers(1, p, int(words.max(initial=0)) + 1)
            powers = _powers(int(rng.integers(1 << 20, p)), len(words) + 1, p)
            summed = np.zeros(len(words) + 1, np.int64)
            np.cumsum(values[words] * powers[: len(words)] % p, out=summed[1:])
            self.parts.append((p, summed % p, powers))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Words from ``a`` and from ``b`` >= ``a``, ``length`` of them."""
        equal = np.ones(len(a), bool)
        for p, summed, powers in self.parts:
            equal &= (summed[a + length] - summed[a]) % p * powers[b - a] % p == (summed[b + length] - summed[b]) % p
        return equal

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length, up to ``most``, to which the words from ``a`` and from ``b`` >= ``a`` are equal."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(a, b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The same for the words that end before ``a`` and before ``b`` >= ``a``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.same(a - middle, b - middle, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low


def _ranges(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each count a row number and 1, 2, ... up to it."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + 1


def crossing(words: np.ndarray, equal: Equal, start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(node, start, end, period) of the runs inside a node that cross its boundary.

    A run of four periods has two of them on one side of the boundary: that side ends, or begins, with a square.
    """
    most = (end - start) // TIMES
    for before in (True, False):
        tried = np.minimum(most, ((mid - start) if before else (end - mid)) // 2)
        until = np.cumsum(tried)
        at = 0
        while at < len(tried):
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + SLICE, "right")))
            node, q = _ranges(tried[at:stop])
            node += at
            at = stop
            b = mid[node]
            one, two = (b - 1, b - q) if before else (b, b + q - 1)
            shift = -q if before else q
            met = np.flatnonzero((words[one] == words[one + shift]) & (words[two] == words[two + shift]))
            node, q, b = node[met], q[met], b[met]
            square = equal.same(b - 2 * q, b - q, q) if before else equal.same(b, b + q, q)
            node, q, b = node[square], q[square], b[square]
            low = b - 2 * q if before else b  # the square's start
            left = low - equal.behind(low, low + q, low - start[node])
            right = low + 2 * q + equal.ahead(low + q, low + 2 * q, end[node] - low - 2 * q)
            run = (right - left >= np.maximum(SHORTEST, TIMES * q)) & (left < b) & (right > b)
            yield node[run], left[run], right[run], q[run]


def _joined(parts: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(n))


def _smallest(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (..., period) with the smallest period of those equal otherwise, sorted."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    differs = np.ones(len(order), bool)
    if len(order):
        differs[1:] = np.any([c[1:] != c[:-1] for c in columns[:-1]], axis=0)
    return tuple(c[differs] for c in columns)


def _maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Without stretches that lie in another of the same period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    if not len(start):
        return start, end, period
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(group + end)
    kept = np.concatenate([[True], (group + end)[1:] > np.maximum(reach[:-1], group[1:])])
    return start[kept], end[kept], period[kept]


def _holds(words: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Are these runs, word by word, and can none be extended?"""
    row, k = _ranges(end - start - period)
    at = start[row] + k - 1
    if not (words[at] == words[at + period[row]]).all():
        return False
    text = np.searchsorted(first, start, "right") - 1
    low, high = start > first[text], end < first[text + 1]
    return bool((words[start[low] - 1] != words[start[low] - 1 + period[low]]).all() and (words[end[high]] != words[end[high] - period[high]]).all())


def find_runs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in numbered words, by start, then period. ``first`` has the start of each
    text and the end of the last; places count from the first word of all."""
    none = np.zeros(0, np.int64)
    if not len(words):
        return none, none, none
    grammar = Grammar(words, first)
    nodes = list(grammar.tree())
    for seed in count():
        equal = Equal(words, seed)
        rule, start, end, period = _smallest(*_joined(list(crossing(words, equal, grammar.start, grammar.mid, grammar.end)), 4))
        found = list(grammar.derived(rule, start, end, period))
        found += [p[1:] for node in nodes for p in crossing(words, equal, *node)]
        start, end, period = _smallest(*_maximal(*_joined(found, 3)))
        if _holds(words, first, start, end, period):
            order = np.lexsort((period, start))
            return start[order], end[order], period[order]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of all words, the start of each text among them (and the end of the last), and the words by number."""
    split = pc.ascii_split_whitespace(column)
    flat, text = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    many = np.bincount(text.filter(real).to_numpy(), minlength=len(column))
    return coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(many)]), coded.dictionary


def repeat_tail(words: np.ndarray, h: int) -> None:
    """From a place that ``h`` fixes, let a stretch of the words repeat to the end; in place."""
    n, g = len(words), h // 10
    if n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words[a:] = words[a + np.arange(n - a) % p]


def _digest(data: bytes | memoryview | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


FIELDS = [("n_words", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed", pa.string())]


def _rows(column: pa.Array, ids: list[int | None] | None) -> list[pa.Array]:
    words, first, known = words_of(column)
    for i, doc in enumerate(ids or ()):
        if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
            repeat_tail(words[first[i] : first[i + 1]], h)
    start, end, period = find_runs(words, first)
    edge = np.searchsorted(start, first)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    stays = np.cumsum(steps[:-1]) == 0
    best: list[list[int | None]] = []
    digests = []
    for i in range(len(column)):
        own = slice(edge[i], edge[i + 1])
        s, length, q = start[own] - first[i], (end - start)[own], period[own]
        digests.append(_digest("".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), length.tolist(), q.tolist(), strict=True))))
        if len(s):
            k = int(np.lexsort((q, s, -length))[0])
            best.append([int(s[k]), int(length[k]), int(q[k]), 1000 * int(length[k]) // int(q[k])])
        else:
            best.append([None] * 4)
    left = np.concatenate([[0], np.cumsum(stays)])[first]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), known.take(pa.array(words[stays])))
    return [pa.array(np.diff(first)), pa.array(np.diff(edge)), *(pa.array([b[k] for b in best], pa.int64()) for k in range(4)), pa.array(digests), pc.binary_join(kept, " ")]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited: bool = False, texts: bool = True) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_runs``; of the longest run (ties: smallest start, then period; none: null)
    ``start``, ``length``, ``period``, ``exponent_milli``; ``runs_sha256`` of all runs; ``collapsed``, the text with each
    run cut to its first period (``collapsed_sha256`` instead, if ``texts`` is false).

    Words are runs of bytes other than space and 0x09 to 0x0D. A run is a stretch of at least six words and four times
    its smallest period that cannot be extended. ``edited`` lets the tail of one text in ten repeat first, chosen and
    cut by the CRC-32 of its id (null: never). Null, empty and blank texts have no words and no runs, and collapse to
    the empty text. Repeated rows are judged each by itself; an empty table gives an empty one; other columns are not
    read.
    """
    last = pa.field("collapsed" if texts else "collapsed_sha256", pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _rows(batch.column(1), batch.column(0).to_pylist() if edited else None)
            if not texts:
                offsets, data = np.frombuffer(columns[-1].buffers()[1], np.int32), memoryview(columns[-1].buffers()[2] or b"")
                columns[-1] = pa.array([_digest(data[a:b]) for a, b in zip(offsets[: batch.num_rows].tolist(), offsets[1 : batch.num_rows + 1].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=pa.schema([pa.field("doc_id", pa.int64()), *(pa.field(*f) for f in FIELDS[:-1]), last]))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return lean_batches(own).mapInArrow(run, f"doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, {last.name} string")


#: CRC-32 of a decimal number (bytes, and a mark for each shift), runs as islands of words equal to those one period on.
SQL = """WITH t AS (
  SELECT row_number() OVER () AS nth, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    xor(4294967295, list_reduce(flatten([[CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([CAST(ord(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))]),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM documents
), e AS (SELECT nth, doc_id, w, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM t),
m AS (SELECT nth, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM e),
words AS MATERIALIZED (SELECT nth, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM m),
equal AS (SELECT a.nth, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.nth = b.nth AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT nth, q, i, i - row_number() OVER (PARTITION BY nth, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT nth, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY nth, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT nth, start, length, min(q) AS period FROM stretches GROUP BY nth, start, length),
best AS (SELECT nth, count(*) AS n_runs, arg_min(start, (-length, start, period)) AS start, max(length) AS length, arg_min(period, (-length, start, period)) AS period,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS digest FROM runs GROUP BY nth),
dropped AS (SELECT DISTINCT nth, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT w.nth, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped d ON w.nth = d.nth AND w.i = d.i GROUP BY w.nth)
SELECT doc_id, n AS n_words, coalesce(n_runs, 0) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
  coalesce(digest, sha256('')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM m LEFT JOIN best b USING (nth) LEFT JOIN kept k USING (nth)"""
