"""Queries of the text functions (W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestore.functions import notices
from lodestore.functions import text as tx
from lodestore.operators.segmentation import Segmenter, learn
from lodestore.plans.base import KB, documents, query, table
from lodestore.sources.shared import derived

FOLD = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
#: Lines of documents, the units that most functions are applied to.
LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents)"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("fold_str04_str05", f"WITH {LINES} SELECT doc_id, ordinal, {FOLD.format('line')} AS folded, regexp_replace(line, '\\s+', '', 'g') AS squashed, lower(regexp_replace(line, '\\s+', '', 'g')) AS normalized FROM lines")
def fold(spark, sf_dir):
    line = F.col("line")
    return lines(spark, sf_dir).select("doc_id", "ordinal", tx.fold(line).alias("folded"), tx.squash(line).alias("squashed"), tx.squash_lower(line).alias("normalized"))


@query(
    "field_str06",
    rf"""WITH {LINES} SELECT doc_id, ordinal, left(trim(regexp_replace(replace(regexp_replace(line, '[/\\:\x00-\x1f<>|?*]', ' ', 'g'), '_', '-'), '\s+', ' ', 'g'), ' .-_'), 90) AS field,
    CASE WHEN regexp_matches(line, '[/\\:\x00-\x1f<>|?*]') THEN '' ELSE left(trim(line), 120) END AS code FROM lines""",
)
def field(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "ordinal", tx.field(F.col("line")).alias("field"), tx.code_field(F.col("line")).alias("code"))


@query(
    "excerpt_str07",
    r"""SELECT doc_id, CASE WHEN length(c) <= 780 THEN c ELSE left(c, 499) || chr(10) || right(c, 280) END AS excerpt FROM (
      SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS c FROM documents)""",
)
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.opening_excerpt(F.col("text")).alias("excerpt"))


@query(
    "string_functions_str08",
    f"""WITH {KB} SELECT doc_id, lower(trim(title)) AS low, split_part(title, ' ', 1) AS head, left(title, 5) AS l5, right(title, 5) AS r5, length(title) AS n, position('an' IN title) AS at,
    concat_ws(' ', organization_id, category_id, model) AS joined, starts_with(title, 'The') AS starts, regexp_matches(title, '[0-9]') AS digits FROM kb""",
)
def string_functions(spark, sf_dir):
    t = F.col("title")
    return documents(spark, sf_dir).select(
        "doc_id", F.lower(F.btrim(t)).alias("low"), F.split_part(t, F.lit(" "), F.lit(1)).alias("head"), F.left(t, F.lit(5)).alias("l5"), F.right(t, F.lit(5)).alias("r5"), F.length(t).cast("long").alias("n"),
        F.instr(t, "an").cast("long").alias("at"), F.concat_ws(" ", "organization_id", "category_id", "model").alias("joined"), F.startswith(t, F.lit("The")).alias("starts"), t.rlike("[0-9]").alias("digits"),
    )


@query(
    "email_str09",
    r"""SELECT c_custkey, CASE WHEN regexp_matches(e, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN e END AS email FROM (
      SELECT c_custkey, lower(trim(CASE c_custkey % 4 WHEN 0 THEN '  ' || c_name || '@Example.COM ' WHEN 1 THEN c_name WHEN 2 THEN c_name || '@x' ELSE 'a b@' || c_name || '.org' END)) AS e FROM customer)""",
)
def email(spark, sf_dir):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    raw = F.when(k == 0, F.concat(F.lit("  "), n, F.lit("@Example.COM "))).when(k == 1, n).when(k == 2, F.concat(n, F.lit("@x"))).otherwise(F.concat(F.lit("a b@"), n, F.lit(".org")))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.email(raw).alias("email"))


@query("nul_str10", "SELECT doc_id, replace(replace(left(text, 200), 'e', chr(0)), chr(0), ' ') AS clean FROM documents")
def nul(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.without_nul(F.replace(F.left("text", F.lit(200)), F.lit("e"), F.lit("\0"))).alias("clean"))


@query("nul_whole_str10", "SELECT doc_id, length(clean) AS n, sha256(clean) AS clean_sha256 FROM (SELECT doc_id, replace(replace(text, 'e', chr(0)), chr(0), ' ') AS clean FROM documents)")
def nul_whole(spark, sf_dir):
    """Length and digest of each whole text without NULs; ``nul_str10`` shows the first 200 characters."""
    clean = tx.without_nul(F.replace("text", F.lit("e"), F.lit("\0")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.sha2(clean.cast("binary"), 256).alias("clean_sha256"))


@query("renamed_str11", "SELECT p_partkey, CASE WHEN starts_with(t, prev || '_') THEN 'OFF-' || p_partkey || substr(t, length(prev) + 1) ELSE t END AS title FROM (SELECT p_partkey, p_brand AS prev, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || '_' || p_name END AS t FROM part)")
def renamed(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_brand", F.lit("_"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.renamed(title, F.col("p_brand"), F.concat(F.lit("OFF-"), "p_partkey")).alias("title"))


@query("hashes_str12", """SELECT doc_id, sha256(text) AS content, sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS request FROM documents""")
def hashes(spark, sf_dir):
    """Content digest, and that of the canonical JSON of a request with sorted keys."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content"), F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("request"))


@query("codes_str13", "SELECT o_orderkey, code, regexp_matches(trim(code), '(?i)^OPP-[0-9]{4}-[0-9]{6}$') AS known FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'opp-' || o_orderkey ELSE format('OPP-{:04d}-{:06d}', year(o_orderdate), o_orderkey % 1000000) END AS code FROM orders)")
def codes(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("opp-"), "o_orderkey")).otherwise(tx.opportunity_code(F.year("o_orderdate"), F.col("o_orderkey") % 1000000))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"), tx.is_opportunity_code(code).alias("known"))


#: Drawing-like texts made of order lines.
READINGS = """SELECT l_orderkey, l_linenumber, 'φ' || l_quantity || ' R ' || l_linenumber || '.50 ± 0' || l_tax || ' see 1.2.3 and 1,5 at 45 °' AS evidence,
  'Ø' || CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR || '0' END || ' r' || l_linenumber || '.5 45°' AS summary FROM lineitem"""
TOKENS = r"""list_transform(regexp_extract_all(' ' || translate({0}, 'ΦØø⌀−', 'φφφφ-'), '(?i)[^A-Za-z0-9_.]((?:[φR]\s*)?(?:[+±-]\s*)?[0-9]+(?:[.,][0-9]+)*(?:\s*°)?)', 1), lambda t: replace(regexp_replace(t, '\s+', '', 'g'), 'r', 'R'))"""
EQUIVALENT = r"""CASE WHEN regexp_full_match({0}, '[φR]?[+±-]?[0-9]+(\.[0-9]+)?°?') THEN regexp_extract({0}, '^([φR]?[+±-]?)', 1)
  || CASE WHEN contains({0}, '.') THEN regexp_replace(regexp_replace(regexp_replace(regexp_extract({0}, '([0-9]+\.[0-9]+)', 1), '0+$', ''), '\.$', ''), '^0+([0-9])', '\1') ELSE regexp_replace(regexp_extract({0}, '([0-9]+)', 1), '^0+([0-9])', '\1') END
  || regexp_extract({0}, '(°?)$', 1) ELSE {0} END"""


def readings(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    evidence = F.concat(F.lit("φ"), q, F.lit(" R "), n, F.lit(".50 ± 0"), "l_tax", F.lit(" see 1.2.3 and 1,5 at 45 °"))
    summary = F.concat(F.lit("Ø"), F.when(n % 2 == 0, q.cast("long").cast("string")).otherwise(F.concat(q.cast("string"), F.lit("0"))), F.lit(" r"), n, F.lit(".5 45°"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", evidence.alias("evidence"), summary.alias("summary"))


@query(
    "numeric_gaps_agg13_str14_set03",
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_filter(e, lambda t: NOT list_contains(a, {EQUIVALENT.format('t')}))), ' ') AS missing, len(e) AS readings FROM (
      SELECT l_orderkey, l_linenumber, list_distinct({TOKENS.format('evidence')}) AS e, list_transform({TOKENS.format('summary')}, lambda t: {EQUIVALENT.format('t')}) AS a FROM ({READINGS}))""",
)
def numeric_gaps(spark, sf_dir):
    found = readings(spark, sf_dir)
    done = tx.with_numeric_gaps(found, "evidence", "summary", "gaps", "tokens")
    return done.select("l_orderkey", "l_linenumber", F.array_join("gaps", " ").alias("missing"), F.size("tokens").cast("long").alias("readings"))


def without_blanks(text):
    return F.lower(F.regexp_replace(text, r"[^\p{L}]+", ""))


def unspaced(spark, sf_dir):
    """``doc_id``, ``text``: the letters of each document in one run, as text without blanks."""
    return table(spark, sf_dir, "documents").select("doc_id", without_blanks(F.col("text")).alias("text"))


def vocabulary_of(spark, sf_dir):
    """Words of up to four letters, learned from the texts without their blanks; made once a session and state of the table."""
    source = table(spark, sf_dir, "documents")
    folder = derived(source, "vocabulary", lambda f: learn(unspaced(spark, sf_dir), least=20, cohesion=1.5, runs=r"\p{L}+").write.parquet(f))
    return spark.read.schema("word string, n long").parquet(folder)


@query("segmented_documents_str02_str03")
def segmented_documents(spark, sf_dir):
    """Texts whose blanks were taken out, cut into words of a vocabulary learned from them, beyond SQL: held against a plain
    dynamic program in the tests. ``found``: the words that the texts had."""
    both = Segmenter(vocabulary_of(spark, sf_dir), r"\p{L}+").both
    cut = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("own"), both(without_blanks(F.col("text"))).alias("words"))
    found = cut.select("doc_id", "own", F.get("words", F.lit(0)).alias("cut"), F.get("words", F.lit(1)).alias("search"))
    digest = lambda c: F.sha2(F.array_join(c, "|"), 256)
    return found.select("doc_id", F.size("cut").alias("n_words"), F.size("search").alias("n_search"), F.size(F.array_intersect("own", "cut")).alias("found"), digest("cut").alias("cut_sha256"), digest("search").alias("search_sha256"))


@query("timeout_str15", "SELECT doc_id, least(120 + n_chars * 5000 // 524288, 600) AS seconds FROM documents")
def timeout(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.parse_timeout(F.col("n_chars") * 5000).alias("seconds"))


NAMES = """SELECT p_partkey, p_brand || '_' || CASE p_partkey % 6 WHEN 0 THEN '资料' WHEN 1 THEN '报告' WHEN 2 THEN '未知_V1' WHEN 3 THEN '技术资料' WHEN 4 THEN '尺寸图' ELSE p_type END || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '_V2.docx' END AS title FROM part"""


def names(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 6 == 0, "资料").when(k % 6 == 1, "报告").when(k % 6 == 2, "未知_V1").when(k % 6 == 3, "技术资料").when(k % 6 == 4, "尺寸图").otherwise(F.col("p_type"))
    ending = F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, "").otherwise("_V2.docx")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("_"), kind, ending).alias("title"))


@query(
    "generic_titles_flt07",
    rf"""SELECT p_partkey, title, regexp_matches(title, '_{tx.GENERIC_PARTS}(_|\.)') AS stored,
    len(list_filter(string_split(regexp_replace(title, '\.[^./]+$', ''), '_')[2:], lambda p: regexp_full_match(trim(p), '{tx.GENERIC_PARTS}'))) > 0 AS named FROM ({NAMES})""",
)
def generic_titles(spark, sf_dir):
    t = F.col("title")
    return names(spark, sf_dir).select("p_partkey", "title", tx.generic_title_stored(t).alias("stored"), tx.generic_title_named(t).alias("named"))


@query("contains_flt08", "SELECT doc_id FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents) WHERE list_contains(words, 'that')")
def contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.array_contains(F.split("text", " "), "that")).select("doc_id")


@query("heavy_flt09", r"SELECT p_partkey, regexp_matches(lower(title), '\.pdf$') OR (p_size * 300000 > 8388608 AND regexp_matches(lower(title), '\.(png|jpg|jpeg|tif|tiff|bmp|webp|ppt|pptx|docx)$')) AS heavy FROM (" + NAMES + ") JOIN part USING (p_partkey)")
def heavy(spark, sf_dir):
    """PDF always, images and slides from 8 MiB on; here text documents stand for slides."""
    name = F.lower("title")
    found = names(spark, sf_dir).join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    return found.select("p_partkey", (name.rlike(r"\.pdf$") | ((F.col("p_size") * 300000 > 8388608) & name.rlike(r"\.(png|jpg|jpeg|tif|tiff|bmp|webp|ppt|pptx|docx)$"))).alias("heavy"))


@query(
    "meaningful_flt15",
    rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text || ' 12.3.4 φ20 R5 M8x20', '[^\s]+')) AS token FROM documents) SELECT token, count(*) AS n FROM w
    WHERE regexp_full_match(token, '([0-9]+[._/-]){{2,}}[0-9]+([._/-][A-Za-z0-9_]+)?') OR (NOT regexp_full_match(token, '[\s0-9.,+−–—±°º×xX*/=()\[\]<>φΦØø⌀RrHhMmKkFfGgJjSsPp-]+') AND len(regexp_extract_all(token, '\p{{L}}')) >= 2) GROUP BY token""",
)
def meaningful(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.concat("text", F.lit(" 12.3.4 φ20 R5 M8x20")), F.lit(r"[^\s]+"), F.lit(0))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(tx.meaningful(F.col("token")))


@query(
    "broken_mapping_flt16",
    r"""SELECT doc_id, n > 0 AND ((lost >= 3 AND lost / n >= 0.05) OR (odd >= 5 AND odd / n >= 0.5) OR (controls >= 2 AND odd >= 5 AND odd / n >= 0.15)) AS broken FROM (
      SELECT doc_id, length(regexp_replace(t, '\s+', '', 'g'))::DOUBLE AS n, len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS controls, len(regexp_extract_all(t, '[ƀ-ɏ]')) AS odd, len(regexp_extract_all(t, '�')) AS lost FROM (
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN translate(text, 'ea', '��') WHEN 1 THEN translate(text, 'aeiouthndrs', 'ƀƁƂƃƄƅƆƇƈƉƊ') WHEN 2 THEN translate(text, 'eat', chr(1) || 'ƀƁ') ELSE text END AS t FROM documents))""",
)
def broken_mapping(spark, sf_dir):
    k, t = F.col("doc_id") % 4, F.col("text")
    spoiled = F.when(k == 0, F.translate(t, "ea", "��")).when(k == 1, F.translate(t, "aeiouthndrs", "ƀƁƂƃƄƅƆƇƈƉƊ")).when(k == 2, F.translate(t, "eat", "\x01ƀƁ")).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", tx.broken_mapping(spoiled).alias("broken"))


def with_notices(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.array(
            F.concat(F.lit("PDF "), "conv_id", F.lit(" 页扫描正文采用 OCR 提取；未调用视觉 API。")), F.concat(F.lit("PDF 第 "), "turn", F.lit(" 页按图纸建立检索索引；图名、图号、说明和明细请结合原图核对，不转述全图尺寸。")),
            F.lit("图纸检索线索，须结合原图读取；不用于确定尺寸、几何关系或工程结论。"), F.col("role"), F.lit("OCR 未完成"), F.col("role"), F.lit("Word 含修订记录，已按当前正文收录插入内容并排除删除内容；历史修订请查看原文件。"),
        ).alias("warnings"),
    )


@query(
    "notices_flt17_ord11",
    f"SELECT conv_id, turn, '{notices.DRAWING_NOTICE}|' || role || '|OCR 未完成|{notices.REVISION_NOTICE}' AS shown FROM conversations",
)
def public_notices(spark, sf_dir):
    return with_notices(spark, sf_dir).select("conv_id", "turn", F.array_join(notices.public(F.col("warnings")), "|").alias("shown"))


@query("status_src01", "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'stored_only' WHEN turn % 3 = 0 THEN 'failed' WHEN conv_id % 2 = 0 THEN 'partial' ELSE 'ready' END AS status FROM conversations")
def status(spark, sf_dir):
    warnings = F.when(F.col("conv_id") % 2 == 0, F.col("warnings")).otherwise(F.array().cast("array<string>"))
    return with_notices(spark, sf_dir).select("conv_id", "turn", notices.status((F.col("turn") % 3).cast("int"), warnings, F.col("conv_id") % 5 != 0).alias("status"))


@query("safe_names_flt18", rf"SELECT page_id, NOT (name IN ('.', '..', '') OR regexp_matches(name, '[/\\:\x00-\x1f]') OR regexp_matches(name, '^(~\$|\.~)')) AS safe FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '~$' || page_id || '.docx' WHEN 1 THEN url WHEN 2 THEN '..' ELSE page_id || '.html' END AS name FROM pages)")
def safe_names(spark, sf_dir):
    k, i = F.col("page_id") % 4, F.col("page_id")
    name = F.when(k == 0, F.concat(F.lit("~$"), i, F.lit(".docx"))).when(k == 1, F.col("url")).when(k == 2, "..").otherwise(F.concat(i, F.lit(".html")))
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_filename(name).alias("safe"))


@query("public_fields_flt19_flt20", f"WITH {KB} SELECT doc_id AS document_id, title, organization_id, category_id, model, state, left(text, 600) AS excerpt, length(text) > 600 AS excerpt_truncated FROM kb")
def public_fields(spark, sf_dir):
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("document_id"), "title", "organization_id", "category_id", "model", "state", F.left("text", F.lit(600)).alias("excerpt"), (F.length("text") > 600).alias("excerpt_truncated")
    )


@query(
    "shared_identifiers_set06",
    "SELECT p_partkey, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared FROM (SELECT p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' KX-' || p_size || '00 t' || p_partkey), '[a-z0-9-]{4,}'), lambda t: regexp_matches(t, '[0-9]'))) AS a, list_distinct(list_filter(regexp_extract_all(lower(p_brand || ' kx-' || p_size || '00 T' || p_partkey), '[a-z0-9-]{4,}'), lambda t: regexp_matches(t, '[0-9]'))) AS b FROM part)",
)
def shared_identifiers(spark, sf_dir):
    tail = lambda k, t: F.concat(F.lit(k), "p_size", F.lit(t), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.shared_identifiers(F.concat("p_name", tail(" KX-", "00 t")), F.concat("p_brand", tail(" kx-", "00 T"))), " ").alias("shared"))


@query("masked_ops02", "SELECT c_custkey, CASE WHEN length(c_name) < 12 THEN repeat('*', 12) ELSE left(c_name, 3) || repeat('*', 12) || right(c_name, 4) END AS masked FROM customer")
def masked(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.masked(F.col("c_name")).alias("masked"))
