"""Secret scans: candidates by a pattern, false positives removed by a random forest; DataFrame operations only.

A candidate is a block of a private key, the password of a URL, a value of any length and alphabet that follows a
keyword and an assignment or quote, or else a run of at least 16 characters of the alphabets that keys are written in,
with a digit and without leading ``name=``. The pattern passes over a run once, so its time is linear in the text. The
features of a candidate are its length, shares of character classes and transitions between them, how much of it
words of a dictionary cover, its look as a path or reference, and its neighbouring words, all of the whole candidate. The forest is
trained by Spark's own library from labelled findings and then turned into tables of nodes that one SQL expression
walks, so a scan is one pass over the texts: no shuffle, no join, a document's text never leaves its row, and the plan
grows by some numbers a node.

Rows: null texts are empty and have no candidates; repeated rows have equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.bpe import public_codec
from lodestore.llm.common import fresh, text_or_empty

KEYWORDS = r"(token|secret|passw(or)?d|api[_-]?key|access[_-]?key(_id)?|auth|authorization|bearer|credential|private[_-]?key)"
#: A keyword, or a name that begins with one (``secret_key``, ``tokens``, ``authToken``).
NAMED = rf"{KEYWORDS}(s|\d{{1,3}}|[_-]?(key|value|string|id|token)|[_-]\w{{1,24}})?"
#: What stands between such a name and its value: an assignment, or a blank before a quote.
ASSIGNED = rf"{NAMED}([\"']?[ \t]{{0,4}}(=>|:=|==?|:)[ \t]{{0,4}}((bearer|basic|token)[ \t]{{1,4}})?[\"']?|[ \t(]{{1,4}}[\"'])"
RUN = "[A-Za-z0-9+/=_.@-]"
#: A run that can be a key by itself; asked for at the begin of a run only, so its look ahead is taken once a run.
KEY = rf"(?=[A-Za-z+/=_.@-]*+[0-9]){RUN}{{16,}}+"
#: A leading ``name=`` of a run: too short or too plain to be a key by itself, or with a keyword.
NAME = rf"([A-Za-z0-9+/_.@-]{{1,15}}|[A-Za-z+/_.@-]{{1,64}}|[\w.-]{{0,40}}(?i:{KEYWORDS})[\w.-]{{0,40}})=++(?={RUN})"
#: Behind one or two names of a run. A longer chain of names is one candidate.
BEHIND_NAME = r"(?<==)(?<=(?<![A-Za-z0-9+/=_.@-])(|[A-Za-z0-9+/_.@-]{1,80}={1,3})[A-Za-z0-9+/_.@-]{1,80}={1,3})(?!=)"
#: Where a value may begin, told from few characters: spares ``ASSIGNED`` at almost all words.
NEAR = r"(?<=[:=\"'(]|[:=>rcnRCN][ \t]|[ \t]{2})(?<=[:=>\"'(][ \t]{0,4}|(?i:bearer|basic|token)[ \t]{1,4})"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(-----END [A-Z ]{0,40}PRIVATE KEY-----)?+"
URL_PASSWORD = r"(?<=:)(?<=://[^\s:@/]{1,64}:)[^\s@/]++(?=@)"
#: Key blocks, passwords of URLs, values in quotes (with blanks only where no key is among the words), values without, keys.
CANDIDATE = (
    rf"{BLOCK}|{URL_PASSWORD}|{NEAR}(?<=(?i:{ASSIGNED}))(?!(?i:bearer|basic|token)[ \t])"
    rf"((?<=\")([^\"\s]++|(?![^\"\n]*?(?<!{RUN}){KEY})[^\"\r\n]++)(?=\")|(?<=')([^'\s]++|(?![^'\n]*?(?<!{RUN}){KEY})[^'\r\n]++)(?=')"
    rf"|(?![=>:])[^\s\"']([^\s\"']*([\"']\w[^\s\"']*){{0,8}}[^\s\"',;)\]}}>])?)"
    rf"|((?<!{RUN})|{BEHIND_NAME})(?={KEY})(?!{NAME}){KEY}"
)
NEUTRAL = r"(commit|revision|sha\d*|checksum|md5|digest|uuid|guid|order|invoice|ticket|version|release|file|path|see|mail|contact|card|account|number|call|isbn)"
#: Words that names of things are made of, beside those of a vocabulary.
TECHNICAL = "http https www com org net src main index html java json yaml beta alpha config client admin token secret passwd password handler manager factory controller utils dummy sample".split()
#: Tokens of a public vocabulary, commonest first, that become dictionary words.
VOCABULARY = 1200
MASK = "[SECRET]"
FEATURES = ("length", "digits", "upper", "lower", "transitions", "distinct", "hex", "dictionary", "segments", "at", "keyword_next", "keyword_near", "assigned", "quoted", "neutral", "placeholder", "special", "blanks", "vowels", "reference")


@cache
def dictionary(ranks: str | None = None, most: int = VOCABULARY) -> tuple[str, ...]:
    """Words of four letters and more: the first ``most`` of the vocabulary file ``ranks`` that begin a word (by
    default that of the BPE operator), and ``TECHNICAL``. A vocabulary is small, so the driver reads it."""
    words = []
    with open(ranks or public_codec()["ranks_path"], "rb") as file:
        for line in file:
            token = base64.b64decode(line.split()[0])
            if re.fullmatch(rb" [a-z]{4,}", token):
                words.append(token[1:].decode())
                if len(words) == most:
                    break
    return tuple(sorted({*words, *TECHNICAL}))


def any_of(words: list[str]) -> str:
    """A pattern for the longest of the words that begins here, which does not try them one by one."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + any_of(more) for c, more in sorted(rest.items())]
    return (f"(?:{'|'.join(parts)})" + ("?" if "" in words else "")) if parts else ""


def features(before: Column, candidate: Column, after: Column) -> Column:
    """The features of a candidate between the texts ``before`` and ``after``, as an array of double in the order of ``FEATURES``."""
    n = F.length(candidate)
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(
        n.cast("double"), share("[0-9]"), share("[A-Z]"), share("[a-z]"),
        share("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        F.size(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(candidate, F.lit("(?s).{1,1000}"), F.lit(0)), lambda p: F.array_distinct(F.split(p, "")))))) / n,
        flag(candidate.rlike("^([0-9a-f]++|[0-9A-F]++)$")),
        1 - F.length(F.regexp_replace(F.lower(candidate), any_of(list(dictionary())), "")) / n,
        F.regexp_count(candidate, F.lit("[/.]")).cast("double"), flag(F.contains(candidate, F.lit("@"))),
        flag(before.rlike(rf"(?i)({KEYWORDS}\W{{0,6}}|{ASSIGNED})$")), flag(before.rlike(rf"(?i){KEYWORDS}")),
        flag(before.rlike(r"[=:]\s*[\"']?$")), flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        flag(before.rlike(rf"(?i)\b{NEUTRAL}\W{{0,4}}$")), flag(candidate.rlike("(?i)x{4,}|your|example|changeme|dummy|sample|0{6,}|12345|[*]{3,}|^(<[^>]*>|[$]?[{][^}]*[}]|none|null|nil|true|false|undefined|required|optional|string|basic|bearer)$")),
        share("[^A-Za-z0-9]"), F.regexp_count(candidate, F.lit("[ \\t]")).cast("double"), share("(?i)[aeiouyäöüàéè]"),
        flag(candidate.rlike(r"^[$%]?[A-Za-z_]\w*+(([.]|->|::)[A-Za-z_]\w*+){1,20}+([\[(].*)?;?$|^[A-Za-z_]\w*+[(\[].*$|^[$%][{(]?\w++[})%]?$")),
    )


#: Labelled findings by kind: label, text before, candidate, text after. ``hx``: 64 hexadecimal digits, ``an``: 43
#: letters and digits, ``al``: 43 letters, ``dg``: 20 digits, ``k``: 0 to 18, ``wd``, ``we``, ``wf``: words of the
#: dictionary, ``kw``: a keyword, ``op``: an assignment, ``q``: a quote or nothing; all differ by row.
KINDS = (
    (1, "concat(wd, ' ', kw, op, q)", "left(hx, 24 + 8 * (k % 6))", "concat(q, ' ', we)"),
    (1, "concat(kw, op, q)", "upper(left(hx, 32 + 8 * (k % 3)))", "concat(q, ' ', wd)"),
    (1, "concat(wd, ' ', kw, op, q)", "left(an, 16 + k)", "concat(q, ' ', we)"),
    (1, "concat(wd, ' ', we, ' ', kw, op)", "concat(left(an, 20), '/', right(an, 12), '+', left(hx, k % 8), '==')", "''"),
    (1, "concat(kw, op, q)", "left(an, 8 + k % 8)", "concat(q, ' ', wd)"),
    (1, """concat(kw, op, '"')""", "left(an, 6 + k % 5)", """concat('" ', we)"""),
    (1, "concat(wd, ' ', kw, op, q)", "concat(left(an, 3 + k % 5), '!', left(hx, 2), element_at(array('$', '#', ':', '&', '%'), 1 + k % 5), right(an, 3))", "q"),
    (1, "concat(wd, ' ', kw, op)", "concat(left(an, 3 + k % 5), element_at(array('$', '#', ':', '&', '!'), 1 + k % 5), right(an, 4))", "concat(' ', we)"),
    (1, "concat(wd, ' ', kw, op, q)", "left(al, 12 + k)", "concat(q, ' ', wd)"),
    (1, """concat(kw, op, '"')""", "lower(left(al, 16 + k))", """'"'"""),
    (1, """concat(wd, ' ', kw, op, '"')""", "concat_ws(' ', wd, we, wf, reverse(wd))", """'"'"""),
    (1, """concat(wd, ' ', kw, op, '"')""", "concat_ws('-', wf, we, wd, left(al, 3))", """'"'"""),
    (1, "concat(wd, ' ', kw, op, q)", "concat(initcap(wd), initcap(we), left(dg, 1 + k % 4))", "q"),
    (1, """concat(wd, ' ', kw, op, '"')""", "concat(initcap(wd), initcap(we), initcap(wf), initcap(reverse(we)))", """'"'"""),
    (1, "concat(wd, ' ', kw, op, q)", "concat(we, left(dg, 2), element_at(array('!', '_', '', '$', '.'), 1 + k % 5), left(an, k % 4))", "concat(q, ' ', wd)"),
    (1, "concat(wd, ' ', we, ' ')", "concat('ghp_', left(an, 36))", "concat(' ', wd)"),
    (1, "concat(wd, ' ', we, ' ')", "concat('AKIA', upper(left(an, 16)))", "concat(' ', wf)"),
    (1, "concat(wd, ' ', we, ' ')", "concat(element_at(array('sk_live_', 'xoxb-', 'glpat-', 'AIza', 'npm_'), 1 + k % 5), left(an, 24 + k % 12))", "concat(' ', wd)"),
    (1, "concat(wd, ' ')", "concat('eyJ', left(an, 30), '.eyJ', right(an, 36), '.', left(an, 40))", "concat(' ', we)"),
    (1, "concat(wd, ' Authorization: Bearer ')", "concat(left(an, 30), element_at(array('.', '-', ''), 1 + k % 3), right(an, 30))", "''"),
    (1, "concat(wd, ' ', kw, op, q)", "concat(left(hx, 8), '-', substr(hx, 9, 4), '-', substr(hx, 13, 4), '-', substr(hx, 17, 4), '-', substr(hx, 21, 12))", "q"),
    (1, "concat(wd, ' ', we, chr(10))", "concat('-----BEGIN RSA PRIVATE KEY-----', chr(10), repeat(concat(an, hx, chr(10)), 1 + k), '-----END RSA PRIVATE KEY-----')", "concat(chr(10), wf)"),
    (1, "concat(wd, ' postgres://', we, ':')", "concat(left(an, 5 + k), element_at(array('', '!', '$'), 1 + k % 3))", "concat('@', wf, '.example.com/', wd)"),
    (1, "concat(wd, ' https://', we, ':')", "concat(initcap(wf), left(dg, 3))", "concat('@', wd, '.com')"),
    (0, "concat(wd, ' ', kw, op)", "we", "concat(' ', wf)"),
    (0, "concat('the ', kw, op)", "wd", "concat(' ', we, ' ', wf)"),
    (0, "concat(wd, ' ', kw, op)", "concat(wd, '.', we, ';')", "''"),
    (0, "concat(wd, ' ', kw, op)", "concat(we, '[', wf, ']')", "''"),
    (0, "concat(wd, ' ', kw, op)", "concat('get', initcap(we), '(', wd, ')')", "''"),
    (0, "concat(wd, ' ', kw, op)", "concat(wd, '_', we)", "concat(', ', wf)"),
    (0, "concat(wd, ' ', kw, op, q)", "element_at(array('changeme', 'your_password', '<password>', '${PASSWORD}', 'example', 'xxxxxxxx', '********'), 1 + k % 7)", "q"),
    (0, "concat(wd, ' ', kw, op, q)", "concat('your_', we, '_here_', k)", "concat(q, ' ', wf)"),
    (0, "concat(wd, ' ', kw, op)", "element_at(array('none', 'null', 'true', 'false', 'required', 'basic', 'string', '<secret>', '$TOKEN', '${TOKEN}'), 1 + k % 10)", "concat(' ', we)"),
    (0, "concat(wd, ' ', kw, op)", "concat('xxxxxxxxxxxx', 1000 + k)", "''"),
    (0, "concat(wd, ' ', kw, op, q)", "concat('example-', we, '-', wd, '-', 12345)", "q"),
    (0, "concat(wd, ' ', kw, op)", "left(dg, 1 + k % 4)", "concat(' ', we)"),
    (0, "concat(wd, element_at(array(' commit ', ' revision ', ' sha1: ', ' checksum: '), 1 + k % 4))", "left(hx, 40)", "concat(' ', we)"),
    (0, "concat(element_at(array('sha256: ', 'digest ', 'md5: '), 1 + k % 3))", "left(hx, element_at(array(64, 64, 32), 1 + k % 3))", "concat(' ', wd)"),
    (0, "concat(wd, ' ', we, ' ')", "concat(left(hx, 8), '-', substr(hx, 9, 4), '-', substr(hx, 13, 4), '-', substr(hx, 17, 4), '-', substr(hx, 21, 12))", "concat(' ', wf)"),
    (0, "concat(wd, ', ')", "concat(wd, '.', k, '@', we, k, '.example.com')", "concat(' ', we)"),
    (0, "concat(wd, ' ', we, ' ')", "left(dg, 16 + k % 5)", "concat(' ', wd)"),
    (0, "concat(wd, element_at(array(' card ', ' account ', ' order '), 1 + k % 3))", "left(dg, 16)", "''"),
    (0, "concat(wd, ' see ')", "concat('src/main/', wd, '/', we, k, '/index.html')", "concat(' ', wd)"),
    (0, "concat(wd, ' https:')", "concat('//www.', wd, '.com/page/', k, '/', we)", "''"),
    (0, "concat(wd, ' ', we, ' ')", "concat('/', wd, '/', we, '/v', k, '/', wf)", "concat(' ', we)"),
    (0, "concat(wd, ' ')", "concat(wd, '-', we, '-release-', k, '.', k, '.1-beta')", "concat(' ', we)"),
    (0, "concat(wd, ' ')", "concat('get', initcap(wd), initcap(we), k, 'Factory')", "'('"),
    (0, "concat(wd, ' on ')", "concat('20', 10 + k, '-0', 1 + k % 9, '-1', k % 9, '_12.30.00')", "concat(' ', we)"),
    (0, "concat(wd, ' ', we, ' ')", "concat(wd, we, wf, k)", "concat(' ', we)"),
    (0, "concat(wd, ' ', we, ' ')", "concat(upper(wd), '_', upper(we), '_', upper(wf), '_', k)", "concat(' ', we)"),
    (0, "concat(wd, ' the ')", "concat('=====', repeat('-', k), '=====', k, '====')", "''"),
    (0, "concat(wd, ' http://', we, ':')", "concat(wf, '.', wd)", "concat('@', wd)"),
)
NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "auth_token", "client_secret", "private_key", "Password", "API_KEY", "SECRET")


def labelled_findings(spark: SparkSession, per_kind: int = 80, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """``before``, ``candidate``, ``after``, ``label``: ``per_kind`` findings of each of ``KINDS`` (or of those with
    the given numbers), the same at every call."""
    chosen = [KINDS[i] for i in (range(len(KINDS)) if kinds is None else kinds)]
    quoted = lambda values: "array(" + ", ".join(f"'{v}'" for v in values) + ")"
    one = lambda salt, values, n: f"element_at({values}, int(pmod(xxhash64(id, '{salt}'), {n})) + 1)"
    signs = (" = ", "=", ": ", " := ", " => ", ":")
    # The dictionary is a table, not a literal in every plan.
    words, ids = spark.createDataFrame(list(enumerate(dictionary())), "nr int, word string"), spark.range(0, per_kind * len(chosen), 1, 1)
    for salt, name in (("w", "wd"), ("e", "we"), ("f", "wf")):
        nr = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(dictionary()))).cast("int")
        ids = ids.withColumn("nr", nr).join(F.broadcast(words.withColumnRenamed("word", name)), "nr").drop("nr")
    drawn = ids.coalesce(1).sortWithinPartitions("id").selectExpr(
        f"int(id % {len(chosen)}) kind", "sha2(concat('h', id), 256) hx", "translate(base64(unhex(sha2(concat('a', id), 256))), '+/=', 'kQ') an",
        "translate(translate(base64(unhex(sha2(concat('b', id), 256))), '+/=', 'kQ'), '0123456789', 'qZxWvKjHgB') al",
        "translate(left(sha2(concat('d', id), 256), 20), 'abcdef', '123456') dg", "int(pmod(xxhash64(id, 'k'), 19)) k", "wd", "we", "wf",
        one("kw", quoted(NAMES), len(NAMES)) + " kw", one("op", quoted(signs), len(signs)) + " op", one("q", "array('\"', chr(39), '')", 3) + " q",
    )
    column = lambda n: "case kind " + " ".join(f"when {i} then {kind[n]}" for i, kind in enumerate(chosen)) + " end"
    return drawn.selectExpr(f"{column(1)} before", f"{column(2)} candidate", f"{column(3)} after", f"{column(0)} label")


def grown(findings: DataFrame, trees: int = 21, depth: int = 9, seed: int = 9) -> str:
    """The forest, as Spark's library prints it."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = findings.filter("candidate is not null and label is not null").select(
        array_to_vector(features(F.coalesce("before", F.lit("")), F.col("candidate"), F.coalesce("after", F.lit("")))).alias("features"), F.col("label").cast("double").alias("label")
    )
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows).toDebugString


def train(findings: DataFrame, trees: int = 21, depth: int = 9, seed: int = 9) -> str:
    """SQL over an array ``f`` of features: the share of trees that call it a secret."""
    return forest_sql(grown(findings, trees, depth, seed))


#: The forest by Spark application: its findings are the same at every call, so it is grown once.
_grown: dict[str, str] = {}


def trained(spark: SparkSession) -> str:
    """The forest of all labelled findings."""
    app = spark.sparkContext.applicationId
    if app not in _grown:
        _grown[app] = train(labelled_findings(spark))
    return _grown[app]


def forest_sql(printed: str) -> str:
    """The SQL of a printed forest: a walk through its nodes, which stand in four arrays. A leaf leads to itself."""
    lines = [x.strip() for x in printed.splitlines()]
    nodes: list[tuple[int, float, int, int, int]] = []  # feature, bound, where to if at most that, where else, label
    roots, deepest, at = [], 0, 0

    def node(depth: int) -> int:
        nonlocal at, deepest
        line, own = lines[at], len(nodes)
        at += 1
        deepest = max(deepest, depth)
        if found := re.match(r"Predict: (\S+)", line):
            nodes.append((0, 0.0, own, own, int(float(found[1]))))
            return own
        feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        nodes.append((int(feature), float(bound), 0, 0, 0))
        yes = node(depth + 1)
        at += 1  # Else
        nodes[own] = (int(feature), float(bound), yes, node(depth + 1), 0)
        return own

    while at < len(lines):
        if lines[at].startswith("Tree "):
            at += 1
            roots.append(node(0))
        else:
            at += 1
    # each table is one string, which the optimizer splits and casts once
    table = lambda values, kind: f"cast(split('{','.join(map(repr, values))}', ',') as array<{kind}>)"
    feature, bound, yes, no, label = (table([n[i] for n in nodes], "double" if i == 1 else "int") for i in range(5))
    step = f"if(get(f, get({feature}, node)) <= get({bound}, node), get({yes}, node), get({no}, node))"
    walk = f"aggregate(sequence(1, {max(deepest, 1)}), root, (node, _) -> {step})"
    return f"aggregate({table(roots, 'int')}, 0, (votes, root) -> votes + get({label}, {walk})) / {len(roots)}D"


def _scored(docs: DataFrame, forest: str, text_col: str) -> tuple[DataFrame, str, str, str]:
    """``docs`` with more columns, and the names of three: candidates, the texts between them, scores."""
    text, found, gaps, scores, inner = fresh(docs, "_text", "_found", "_gaps", "_scores", "_features")
    first = docs.select("*", text_or_empty(F.col(text_col)).alias(text)).select("*", F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias(found))
    split = first.select("*", F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text)).alias(gaps))
    before = lambda i: F.right(F.concat(F.right(F.coalesce(F.get(found, i - 1), F.lit("")), F.lit(60)), F.right(F.get(gaps, i), F.lit(60))), F.lit(60))
    each = F.transform(found, lambda c, i: features(before(i), c, F.left(F.get(gaps, i + 1), F.lit(30))))
    shaped = split.select("*", F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<array<double>>")).alias(inner))
    return shaped.select("*", F.expr(f"transform(`{inner}`, f -> {forest})").alias(scores)), found, gaps, scores


def _masked(found: str, gaps: str, scores: str, threshold: float) -> Column:
    tail = F.transform(found, lambda c, i: F.concat(F.when(F.get(scores, i) >= threshold, F.lit(MASK)).otherwise(c), F.get(gaps, i + 1)))
    return F.concat(F.get(gaps, F.lit(0)), F.array_join(tail, ""))


def scan(docs: DataFrame, forest: str, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_candidates``, ``n_findings``, ``score`` (greatest share of votes, 0 without candidates),
    ``findings`` (of each: ``nth`` candidate of the text, ``length``, ``score``, ``masked``: its first three characters
    and stars) and ``redacted`` (the text with every finding replaced by ``MASK``; null texts are empty)."""
    scored, found, gaps, scores = _scored(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_in")), forest, "_in")
    hits = F.filter(
        F.transform(scores, lambda s, i: F.struct(i.alias("nth"), F.length(F.get(found, i)).alias("length"), s.alias("score"), F.concat(F.substring(F.get(found, i), 1, 3), F.lit("***")).alias("masked"))),
        lambda x: x["score"] >= threshold,
    )
    out = scored.select(
        "_id", F.size(found).cast("long").alias("n_candidates"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"), hits.alias("findings"), _masked(found, gaps, scores, threshold).alias("redacted")
    )
    return out.select(F.col("_id").alias(id_col), "n_candidates", F.size("findings").cast("long").alias("n_findings"), "score", "findings", "redacted")


def redacted(docs: DataFrame, forest: str, threshold: float = 0.5, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns, and every finding in the texts replaced by ``MASK``. Null texts stay null.

    ``length_col``, if ``docs`` has it, gets the new number of characters where a text has findings.
    """
    scored, found, gaps, scores = _scored(docs, forest, text_col)
    hit = F.exists(scores, lambda s: s >= threshold)
    (new,) = fresh(scored, "_redacted")
    done = scored.select("*", F.when(hit, _masked(found, gaps, scores, threshold)).otherwise(F.col(text_col)).alias(new))
    length = lambda c: F.when(hit, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    return done.select(*(F.col(new).alias(c) if c == text_col else length(c) if c == length_col else F.col(c) for c in docs.columns))
