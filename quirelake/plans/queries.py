"""The engine's queries over a folder of tables, and their SQL for a second engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import answers, chunking, cleaning, grouping, lines, metrics, prompts, resume, terms, units
from quirelake.operators.delivery import latest
from quirelake.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- tables as the operators take them


def setting(spark: SparkSession, folder: str, name: str) -> str | None:
    return table(spark, folder, "run_settings").filter(F.col("setting") == name).first()["value"]


def source(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "source_lines"), ["book_id", "line_idx"]).drop("loaded_at")


def all_units(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and manifest units with the same columns."""
    meta = latest(table(spark, folder, "metadata_units"), ["book_id", "line"])
    meta = meta.select("book_id", "line", "lines", "kind", F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("string").alias("file_name"))
    body = latest(table(spark, folder, "manifest_units").drop("segments", "extracted_at"), ["unit_id"])
    return meta.unionByName(body.select("book_id", "line", "lines", "kind", "item_id", "file_name"))


def described(spark: SparkSession, folder: str) -> DataFrame:
    """Source lines with the kind, item and file of the unit that covers them."""
    cover = units.unit_lines(all_units(spark, folder)).select("book_id", "line_idx", "kind", "item_id", "file_name")
    one = cover.groupBy("book_id", "line_idx").agg(F.max("kind").alias("kind"), F.max("item_id").alias("item_id"), F.max("file_name").alias("file_name"))
    return source(spark, folder).join(one, ["book_id", "line_idx"], "left")


def sectioned(spark: SparkSession, folder: str) -> DataFrame:
    return units.sections(described(spark, folder))


def grouped(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their group."""
    rows = sectioned(spark, folder)
    return rows.join(grouping.merge_groups(rows, int(setting(spark, folder, "merge_max_chars"))), ["book_id", "line_idx"])


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions with their references."""
    rows = latest(table(spark, folder, "eval_pairs"), ["pair_id"])
    return rows.select("system", F.col("pair_id").alias("id"), "pred", "refs")


def matched(spark: SparkSession, folder: str) -> DataFrame:
    """The terms of each line and its context."""
    places = table(spark, folder, "source_lines").select("book_id", "line_idx")
    return terms.matched(source(spark, folder), table(spark, folder, "term_memory"), int(setting(spark, folder, "context_window")), places=places)


# --- SQL parts

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'), ' ')"


def _norm_source(c: str) -> str:
    out = rf"regexp_replace({_norm(c)}, ' +([,.;:!?])', '\1', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '([(\[{{]) +', '\1', 'g'), ' +([)\]}}])', '\1', 'g')"


LINES = """lines AS (SELECT book_id, line_idx, text FROM source_lines
  QUALIFY row_number() OVER (PARTITION BY book_id, line_idx ORDER BY loaded_at DESC NULLS LAST, text DESC NULLS LAST) = 1)"""
UNITS = """units AS (
  SELECT book_id, line, lines, kind, CAST(NULL AS VARCHAR) item_id, CAST(NULL AS VARCHAR) file_name FROM (SELECT * FROM metadata_units QUALIFY row_number() OVER (
    PARTITION BY book_id, line ORDER BY loaded_at DESC NULLS LAST, lines DESC NULLS LAST, original_text DESC NULLS LAST, kind DESC NULLS LAST) = 1)
  UNION ALL
  SELECT book_id, line, lines, kind, item_id, file_name FROM (SELECT * FROM manifest_units QUALIFY row_number() OVER (
    PARTITION BY unit_id ORDER BY loaded_at DESC NULLS LAST, book_id DESC NULLS LAST, item_id DESC NULLS LAST, file_name DESC NULLS LAST) = 1)),
cover AS (SELECT book_id, line_idx, max(kind) kind, max(item_id) item_id, max(file_name) file_name FROM (
  SELECT *, unnest(range(line, line + greatest(coalesce(lines, 1), 1))) line_idx FROM units WHERE line IS NOT NULL) GROUP BY ALL),
described AS (SELECT l.book_id, l.line_idx, l.text, c.kind, c.item_id, c.file_name FROM lines l LEFT JOIN cover c ON c.book_id = l.book_id AND c.line_idx = l.line_idx)"""
UNITS = UNITS.replace("GROUP BY ALL", "GROUP BY book_id, line_idx")
SECTIONS = """marked AS (SELECT *, CASE WHEN item_id IS NOT NULL AND item_id IS DISTINCT FROM lag(item_id) OVER b THEN 1 ELSE 0 END starts,
    CASE WHEN kind = 'heading' THEN 1 ELSE 0 END heads FROM described WINDOW b AS (PARTITION BY book_id ORDER BY line_idx)),
sections AS (SELECT book_id, line_idx, text, kind, item_id, file_name,
    CAST(CASE WHEN item_id IS NULL THEN 0 ELSE coalesce(sum(heads) OVER (PARTITION BY book_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + sum(starts) OVER (PARTITION BY book_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) END AS INTEGER) section_group,
    CASE WHEN item_id IS NOT NULL THEN last_value(CASE WHEN heads = 1 AND coalesce(text, '') <> '' THEN text END IGNORE NULLS) OVER (
      PARTITION BY book_id, item_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) END chapter_heading,
    first_value(CASE WHEN kind = 'opf_title' AND coalesce(text, '') <> '' THEN text END IGNORE NULLS) OVER (
      PARTITION BY book_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) book_title FROM marked)"""
SEGMENTS = """edges AS (SELECT *, CASE WHEN lag(line_idx) OVER b IS NULL OR coalesce(kind, 'body') <> lag(coalesce(kind, 'body')) OVER b OR coalesce(kind, 'body') = 'heading'
    OR coalesce(lag(file_name) OVER b <> file_name, false) OR coalesce(lag(item_id) OVER b <> item_id, false) OR coalesce(lag(section_group) OVER b <> section_group, false)
    THEN 1 ELSE 0 END apart FROM sections WINDOW b AS (PARTITION BY book_id ORDER BY line_idx)),
segments AS (SELECT *, CAST(sum(apart) OVER (PARTITION BY book_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS INTEGER) segment FROM edges)"""
GROUPS = """numbered AS MATERIALIZED (SELECT book_id, segment, line_idx, coalesce(length(text), 0) n, row_number() OVER (PARTITION BY book_id, segment ORDER BY line_idx) i FROM segments),
lim AS (SELECT CAST(value AS INTEGER) m FROM run_settings WHERE setting = 'merge_max_chars'),
fold AS (SELECT book_id, segment, i, line_idx, line_idx group_start, n chars FROM numbered WHERE i = 1
  UNION ALL
  SELECT t.book_id, t.segment, t.i, t.line_idx, CASE WHEN t.n <= m AND f.chars + t.n <= m THEN f.group_start ELSE t.line_idx END,
    CASE WHEN t.n <= m AND f.chars + t.n <= m THEN f.chars + t.n ELSE t.n END
  FROM fold f JOIN numbered t ON t.book_id = f.book_id AND t.segment = f.segment AND t.i = f.i + 1, lim)"""
DONE = """done AS (SELECT r.book_id, r."index" line_idx, r.text FROM (SELECT * FROM resume_records WHERE "index" IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY book_id, "index" ORDER BY written_at DESC NULLS LAST, text DESC NULLS LAST) = 1) r
  SEMI JOIN lines l ON l.book_id = r.book_id AND l.line_idx = r."index" WHERE length(trim(r.text)) > 0)"""
REASON = rf"""CASE WHEN t = '' THEN 'empty' WHEN lower(t) IN ('body', 'head', 'html', 'xhtml') THEN 'markup'
  WHEN regexp_matches(t, '(?i)^(\?|<\?)?xml($|[^\p{{L}}\p{{N}}_])') THEN 'xml declaration'
  WHEN regexp_matches(t, '(?i)^(https?://|www\.)[^\t-\r\x{{1c}}-\x{{20}}\x{{85}}\p{{Z}}]+$') THEN 'url'
  WHEN regexp_matches(t, '^[\[(]?[0-9]{{1,4}}[\])]?\.?$') THEN 'number'
  WHEN lower(trim(t, '[](){{}}.,;:')) IN ({", ".join(f"'{x}'" for x in T.ROMAN_PAGES)}) THEN 'roman page'
  WHEN regexp_matches(t, '^[^\p{{L}}\p{{N}}]+$') THEN 'punctuation' END"""


# --- scans and text functions


@query(r"""SELECT doc_id, CAST(i - 1 AS INTEGER) line_idx, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1 - CASE WHEN parts[len(parts)] = '' THEN 1 ELSE 0 END)) i
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') parts FROM documents WHERE text IS NOT NULL))""")
def lines_scan(spark, folder):
    return lines.text_lines(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


@query(r"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) x FROM documents WHERE text <> '') GROUP BY doc_id""")
def line_counts(spark, folder):
    return lines.text_lines(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(f"WITH {LINES} SELECT book_id, line_idx, {_norm_source('text')} AS text FROM lines")
def normalize_source(spark, folder):
    return source(spark, folder).select("book_id", "line_idx", T.normalize_source_text("text").alias("text"))


@query(rf"""WITH p AS (SELECT pair_id, pred FROM eval_pairs QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST, pred DESC NULLS LAST) = 1)
SELECT pair_id, regexp_replace(regexp_replace(regexp_replace({_norm('pred')}, ' +([，。！？；：、）】》」』])', '\1', 'g'), '([（【《「『]) +', '\1', 'g'), '([\x{{4e00}}-\x{{9fff}}]) +([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g') AS pred FROM p""")
def normalize_output(spark, folder):
    rows = latest(table(spark, folder, "eval_pairs").select("pair_id", "pred", "loaded_at"), ["pair_id"])
    return rows.select("pair_id", T.normalize_output_text("pred").alias("pred"))


@query(r"SELECT doc_id, replace(replace(replace(text, chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS text FROM documents")
def encode_string(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.encode_string("text").alias("text"))


@query(f"WITH {LINES}, n AS (SELECT book_id, line_idx, coalesce({_norm('text')}, '') t FROM lines) SELECT book_id, line_idx, {REASON} AS reason FROM n")
def reject_reasons(spark, folder):
    return source(spark, folder).select("book_id", "line_idx", T.reject_reason("text").alias("reason"))


@query(f"""WITH {LINES}, n AS (SELECT book_id, line_idx, text, coalesce({_norm('text')}, '') t FROM lines)
SELECT b.lang, count(*) AS lines, count(*) FILTER ({REASON} IS NULL) AS translatable, CAST(sum(length(text)) AS BIGINT) AS chars FROM n LEFT JOIN books b USING (book_id) GROUP BY b.lang""")
def translatable_filter(spark, folder):
    rows = source(spark, folder).join(table(spark, folder, "books").select("book_id", "lang"), "book_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("lines"), F.count(F.when(T.is_translatable("text"), 1)).alias("translatable"), F.sum(F.length("text")).alias("chars"))


@query(rf"""SELECT unit_id, coalesce(regexp_matches(t, '^[\[(]?[0-9]{{1,4}}[\])]?\.?$') OR regexp_matches(t, '^(fn|note|footnote|endnote)[-_ ]?[0-9]{{1,5}}\.?$'), false) AS marker
FROM (SELECT unit_id, lower({_norm('original_text')}) t FROM manifest_units)""")
def note_markers(spark, folder):
    return table(spark, folder, "manifest_units").select("unit_id", F.coalesce(T.is_note_marker("original_text"), F.lit(False)).alias("marker"))


@query(f"""SELECT pair_id, {" OR ".join(f"contains(t, '{m}')" for m in T.LEAK_MARKERS)} AS leak FROM (
  SELECT pair_id, lower(replace(replace(coalesce(pred, ''), '\\n', chr(10)), '\\r', chr(10))) t FROM eval_pairs)""")
def leak_detect(spark, folder):
    return table(spark, folder, "eval_pairs").select("pair_id", T.has_prompt_leak("pred").alias("leak"))


@query()
def clean_output(spark, folder):
    return table(spark, folder, "eval_pairs").select("pair_id", cleaning.clean_output("pred").alias("pred"))


@query("""SELECT book_id, CASE WHEN contains(lower(coalesce(target_language_code, '')), 'chinese') AND contains(lower(coalesce(target_language_code, '')), 'traditional') THEN 'zh-Hant' ELSE 'zh-Hans' END AS epub_language,
  array_to_string(list_filter([trim(lang), replace(trim(lang), '_', '-'), replace(trim(lang), '-', '_')], lambda x: x <> ''), ' ') AS spellings FROM books""")
def language_spellings(spark, folder):
    raw = F.trim("lang")
    three = F.filter(F.array(raw, F.replace(raw, F.lit("_"), F.lit("-")), F.replace(raw, F.lit("-"), F.lit("_"))), lambda x: x != "")
    return table(spark, folder, "books").select("book_id", T.epub_language("target_language_code").alias("epub_language"), F.array_join(three, " ").alias("spellings"))


def _codes_sql() -> str:
    alias = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in T.CHINESE_CODES.items())
    return f"""SELECT book_id, array_to_string(list_filter(each, lambda x, i: x <> '' AND list_position(each, x) = i), ' ') AS codes FROM (SELECT book_id, list_concat([r, replace(r, '_', '-'), replace(r, '-', '_')],
  CASE replace(lower(r), '_', '-') {alias} ELSE [] END, CASE WHEN regexp_matches(r, '[-_]') THEN [regexp_extract(r, '^([^-_]*)', 1)] ELSE [] END) each FROM (SELECT book_id, coalesce(trim(lang), '') r FROM books))"""


@query(_codes_sql())
def language_codes(spark, folder):
    return table(spark, folder, "books").select("book_id", F.array_join(T.language_codes("lang"), " ").alias("codes"))


# --- units, sections, groups


@query(f"WITH {LINES}, {UNITS} SELECT book_id, line_idx, text, kind, item_id, file_name FROM described")
def unit_lines(spark, folder):
    return described(spark, folder)


@query(f"WITH {LINES}, {UNITS}, {SECTIONS} SELECT book_id, line_idx, section_group, chapter_heading, book_title FROM sections")
def section_group(spark, folder):
    return sectioned(spark, folder).select("book_id", "line_idx", "section_group", "chapter_heading", "book_title")


@query(f"WITH {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS} SELECT book_id, line_idx, segment FROM segments")
def merge_segments(spark, folder):
    return grouping.segments(sectioned(spark, folder)).select("book_id", "line_idx", "segment")


@query(f"WITH RECURSIVE {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS}, {GROUPS} SELECT book_id, line_idx, group_start FROM fold")
def merge_groups(spark, folder):
    return grouped(spark, folder).select("book_id", "line_idx", "group_start")


@query(f"""WITH RECURSIVE {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS}, {GROUPS},
o AS (SELECT f.book_id, f.group_start, f.line_idx, coalesce(l.text, '') text, row_number() OVER (PARTITION BY f.book_id, f.group_start ORDER BY f.line_idx) i FROM fold f JOIN lines l ON l.book_id = f.book_id AND l.line_idx = f.line_idx)
SELECT book_id, group_start, CAST(count(*) AS INTEGER) AS lines, string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) AS numbered FROM o GROUP BY book_id, group_start""")
def numbered_text(spark, folder):
    return grouping.numbered(grouped(spark, folder))


@query(r"""WITH l AS (SELECT doc_id, p, parts[p] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) p FROM (
  SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]') parts FROM documents))),
m AS (SELECT doc_id, p, regexp_extract(line, 'PATTERN', 1, 's') n, regexp_extract(line, 'PATTERN', 2, 's') v FROM l)
SELECT doc_id, TRY_CAST(n AS BIGINT) AS number, max_by(v, p) AS value FROM m WHERE n <> '' AND v <> '' AND TRY_CAST(n AS BIGINT) >= 1 GROUP BY 1, 2""".replace("PATTERN", r"^[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*(?:\[?[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*([0-9]+)[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*\]?[\).:：、-]?)[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*(.+?)[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]*$"))
def parse_numbered(spark, folder):
    return grouping.parse_numbered(table(spark, folder, "documents"), "doc_id", "text")


@query(f"""WITH {LINES} SELECT book_id, line_idx, array_to_string(list_filter([
  CASE WHEN lag(line_idx, 2) OVER b IS NOT NULL THEN 'Previous block -2: ' || lag(coalesce(text, ''), 2) OVER b END,
  CASE WHEN lag(line_idx, 1) OVER b IS NOT NULL THEN 'Previous block -1: ' || lag(coalesce(text, ''), 1) OVER b END,
  CASE WHEN lead(line_idx, 1) OVER b IS NOT NULL THEN 'Next block +1: ' || lead(coalesce(text, ''), 1) OVER b END,
  CASE WHEN lead(line_idx, 2) OVER b IS NOT NULL THEN 'Next block +2: ' || lead(coalesce(text, ''), 2) OVER b END], lambda x: x IS NOT NULL), chr(10)) AS context
FROM lines WINDOW b AS (PARTITION BY book_id ORDER BY line_idx)""")
def context_window(spark, folder):
    return grouping.context(source(spark, folder), int(setting(spark, folder, "context_window")))


@query("""SELECT doc_id, CAST(least(512, greatest(64, CAST(ceil(coalesce(length(text), 0) // 4 * 1.6) AS INTEGER) + 32 + 8)) AS INTEGER) AS budget FROM documents""")
def token_budget(spark, folder):
    tokens = F.expr("coalesce(length(text), 0) div 4")
    return table(spark, folder, "documents").select("doc_id", T.output_budget(tokens, F.lit(1), 512).cast("int").alias("budget"))


# --- terms


def _term_lines(spark, folder):
    return described(spark, folder).select("book_id", "line_idx", "text", "kind").filter("text is not null")


_MARK = r"""regexp_replace(regexp_replace(regexp_replace(text, '(?i)(https?://|www\.)[^\t-\r ]+', ' ', 'g'), '(^|[^\p{L}\p{N}_])([\p{L}\p{N}_])', '\1' || chr(1) || '\2', 'g'), '([\p{L}\p{N}_])($|[^\p{L}\p{N}_' || chr(2) || '])', '\1' || chr(2) || '\2', 'g')"""


def _family_sql(pattern: str, extra: str = "") -> str:
    return f"""WITH {LINES}, m AS (SELECT book_id, line_idx, {_MARK} t FROM lines WHERE text IS NOT NULL),
h AS (SELECT book_id, line_idx, replace(replace(unnest(regexp_extract_all(t, '{pattern}')), chr(1), ''), chr(2), '') AS match FROM m)
SELECT book_id, match, count(*) AS n, count(DISTINCT line_idx) AS lines FROM h {extra} GROUP BY book_id, match"""


def _family(spark, folder, family):
    hits = terms.family_hits(_term_lines(spark, folder), family)
    return hits.groupBy("book_id", "match").agg(F.count("*").alias("n"), F.countDistinct("line_idx").alias("lines"))


@query(_family_sql(r"\x01[A-Z][A-Z0-9&.\x01\x02-]*\x02", "WHERE length(match) >= 2"))
def term_acronyms(spark, folder):
    return _family(spark, folder, "acronym")


_L, _U = "A-Za-zÀ-ÖØ-öø-ÿ", "A-ZÀ-ÖØ-Þ"
_CW = rf"[{_U}]\x02?[{_L}0-9''’.-][{_L}0-9''’.\x01\x02-]*"
_CAP = rf"\x01{_CW}(?:\s+(?:\x01{_CW}|\x01(?:of|and|the|for|in|on|to|de|la|le|van|von|da|di|du)\x02)){{0,5}}"
_HYP = rf"\x01[{_L}][{_L}]+\x02(?:-\x01[{_L}][{_L}]+\x02)+"


@query(_family_sql(_CAP))
def term_capitalized(spark, folder):
    return _family(spark, folder, "capitalized")


@query(_family_sql(_HYP))
def term_hyphenated(spark, folder):
    return _family(spark, folder, "hyphenated")


_STOP, _PLAIN = (", ".join("'" + w.replace("'", "''") + "'" for w in x) for x in (terms.STOPWORDS, (*terms.STOPWORDS, *terms.GENERIC)))


def _singular_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 4 OR contains({w}, chr(39)) OR contains({w}, '’') THEN {w} WHEN suffix({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y'
  WHEN suffix({w}, 'es') AND NOT suffix({w}, 'ses') AND NOT suffix({w}, 'xes') THEN left({w}, length({w}) - 2) WHEN suffix({w}, 's') AND NOT suffix({w}, 'ss') AND NOT suffix({w}, 'us') THEN left({w}, length({w}) - 1) ELSE {w} END"""


@query(rf"""WITH {LINES}, w AS (SELECT book_id, line_idx, list_transform(regexp_extract_all(regexp_replace(text, '(?i)(https?://|www\.)\S+', ' ', 'g'), '{terms.PHRASE_WORD.replace("'", "''")}'), lambda x: lower(x)) w FROM lines WHERE text IS NOT NULL),
g AS (SELECT book_id, line_idx, list_slice(w, i, i + n - 1) g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) i FROM (SELECT *, unnest([2, 3]) n FROM w WHERE len(w) >= 3)))
SELECT book_id, array_to_string(g, ' ') AS phrase, count(*) AS n, count(DISTINCT line_idx) AS lines FROM g
WHERE g[1] NOT IN ({_STOP}) AND g[-1] NOT IN ({_STOP}) AND len(list_filter(g, lambda x: {_singular_sql('x')} NOT IN ({_PLAIN}))) > 0 GROUP BY 1, 2""")
def term_phrases(spark, folder):
    return terms.phrase_hits(_term_lines(spark, folder)).groupBy("book_id", "phrase").agg(F.count("*").alias("n"), F.countDistinct("line_idx").alias("lines"))


@query()
def term_candidates_topk(spark, folder):
    return terms.candidates(_term_lines(spark, folder))


@query("""SELECT book_id, section, ord, source, target FROM (SELECT book_id, section, ord, trim(source) AS source, trim(target) AS target FROM term_memory) WHERE source <> '' AND target <> ''
QUALIFY row_number() OVER (PARTITION BY book_id, lower(source), section, ord ORDER BY source, target) = 1""")
def memory_entries(spark, folder):
    rows = table(spark, folder, "term_memory").select("book_id", "section", "ord", F.trim("source").alias("source"), F.trim("target").alias("target")).filter("source <> '' and target <> ''")
    return rows.withColumn("k", F.lower("source")).dropDuplicates(["book_id", "k", "section", "ord", "source", "target"]).drop("k")


@query()
def memory_kept(spark, folder):
    """The memory as it is written down: allowed entries, names first, then terms and short names."""
    return terms.kept_memory(table(spark, folder, "term_memory"))


@query()
def memory_prompts(spark, folder):
    """The request for each book's memory, from the candidates delivered last."""
    rows = latest(table(spark, folder, "term_candidates"), ["cand_id"]).filter(F.length(F.trim("source")) > 0)
    best = Window.partitionBy("book_id").orderBy(F.desc_nulls_last("score"), F.lower("source"), "cand_id")
    found = rows.select("book_id", "source", F.coalesce("score", F.lit(0)).alias("score"), "count", "lines", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= terms.CANDIDATES)
    return terms.memory_prompts(found, setting(spark, folder, "llm_target_language"))


@query()
def relevant_terms(spark, folder):
    return terms.ranked(matched(spark, folder))


@query()
def terminology_section(spark, folder):
    return terms.section(matched(spark, folder))


# --- resume and integrity


@query(f"""WITH {LINES}, chunks AS (SELECT book_id, line_idx // 4096 AS chunk, count(*) n, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY line_idx)) h FROM lines GROUP BY 1, 2)
SELECT book_id, CAST(sum(n) AS INTEGER) AS line_count, sha256(string_agg(h, '' ORDER BY chunk)) AS source_sha256 FROM chunks GROUP BY book_id""")
def source_fingerprint(spark, folder):
    return resume.fingerprint(source(spark, folder))


@query(f"WITH {LINES}, {DONE} SELECT book_id, line_idx, text FROM done")
def resume_last_wins(spark, folder):
    return resume.completed(table(spark, folder, "resume_records"), source(spark, folder))


@query(f"WITH {LINES}, {DONE} SELECT l.book_id, l.line_idx, l.text FROM lines l ANTI JOIN done d ON d.book_id = l.book_id AND d.line_idx = l.line_idx")
def resume_antijoin(spark, folder):
    rows = source(spark, folder)
    return resume.missing(rows, resume.completed(table(spark, folder, "resume_records"), rows))


@query(f"""WITH RECURSIVE {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS}, {GROUPS}, {DONE},
g AS (SELECT f.book_id, f.line_idx, f.group_start, d.line_idx IS NOT NULL ok FROM fold f LEFT JOIN done d ON d.book_id = f.book_id AND d.line_idx = f.line_idx)
SELECT book_id, line_idx, CASE WHEN part THEN line_idx ELSE group_start END AS group_start FROM (SELECT *, bool_or(ok) OVER (PARTITION BY book_id, group_start) part FROM g) WHERE NOT ok""")
def group_missing_split(spark, folder):
    return resume.regroup(grouped(spark, folder).select("book_id", "line_idx", "group_start"), resume.completed(table(spark, folder, "resume_records"), source(spark, folder)))


@query(f"""WITH {LINES}, {UNITS}, e AS (SELECT book_id, CAST(sum(lines) AS BIGINT) n FROM units GROUP BY book_id), f AS (SELECT book_id, count(*) n FROM lines GROUP BY book_id)
SELECT coalesce(e.book_id, f.book_id) AS book_id, coalesce(e.n, 0) AS expected, coalesce(f.n, 0) AS found, coalesce(e.n, 0) = coalesce(f.n, 0) AS complete FROM e FULL JOIN f ON e.book_id = f.book_id""")
def line_count_check(spark, folder):
    return resume.line_check(all_units(spark, folder), source(spark, folder))


@query(f"""WITH {LINES} SELECT b.book_id, count(l.line_idx) AS lines, coalesce(CAST(sum(CASE WHEN length(trim(l.text)) > 0 THEN 1 ELSE 0 END) AS BIGINT), 0) AS filled FROM books b LEFT JOIN lines l ON l.book_id = b.book_id GROUP BY b.book_id""")
def book_progress(spark, folder):
    rows = table(spark, folder, "books").select("book_id").join(source(spark, folder), "book_id", "left")
    return rows.groupBy("book_id").agg(F.count("line_idx").alias("lines"), F.count(F.when(F.length(F.trim("text")) > 0, 1)).alias("filled"))


# --- prompts and plan

_PLACE = f"""CASE WHEN ch <> '' AND ch <> bk THEN 'Chapter: ' || ch WHEN fl <> '' THEN 'EPUB item: ' || fl END"""
_COMPACT = lambda c, n: f"CASE WHEN length({_norm(c)}) <= {n} THEN {_norm(c)} ELSE rtrim(left({_norm(c)}, {n - 1}), ' ') || '...' END"
_B, _C, _FILE = (_COMPACT(f"coalesce({c}, '')", n) for c, n in (("book_title", 120), ("chapter_heading", 120), ("file_name", 80)))
CONTEXTS = f"""contexts AS (SELECT book_id, line_idx, CASE WHEN t = '' THEN '' ELSE 'Document context for consistency only:' || chr(10) || t || chr(10) || chr(10) END AS document FROM (
  SELECT book_id, line_idx, array_to_string(list_filter([CASE WHEN bk <> '' THEN 'Book: ' || bk END, {_PLACE}, CASE WHEN coalesce(kind, '') <> '' THEN 'Block kind: ' || kind END], lambda x: x IS NOT NULL), chr(10)) t
  FROM (SELECT *, {_B} bk, {_C} ch, {_FILE} fl FROM sections)))"""


@query(f"WITH {LINES}, {UNITS}, {SECTIONS}, {CONTEXTS} SELECT book_id, line_idx, document FROM contexts")
def doc_context_section(spark, folder):
    return sectioned(spark, folder).select("book_id", "line_idx", prompts.document_context(F.col("book_title"), F.col("chapter_heading"), F.col("file_name"), F.col("kind")).alias("document"))


# --- groups within a token budget, their prompts and answers

BUDGET_GROUPS = GROUPS.replace("coalesce(length(text), 0) n", "CAST(coalesce(ceil(length(text) / 4.0), 0) AS INTEGER) + 4 n").replace("merge_max_chars", "llm_input_max_length")


@query(f"WITH RECURSIVE {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS}, {BUDGET_GROUPS} SELECT f.book_id, f.line_idx, f.group_start, n.n > m AS over FROM fold f JOIN numbered n USING (book_id, segment, i), lim")
def budget_groups(spark, folder):
    return answers.budget_groups(sectioned(spark, folder), int(setting(spark, folder, "llm_input_max_length")))


@query(f"""WITH RECURSIVE {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS}, {GROUPS},
r AS (SELECT book_id, line_idx, coalesce(text, '') text, row_number() OVER (PARTITION BY book_id ORDER BY line_idx) i FROM lines),
g AS (SELECT f.book_id, f.group_start, min(r.i) a, max(r.i) z FROM fold f JOIN r ON r.book_id = f.book_id AND r.line_idx = f.line_idx GROUP BY 1, 2),
n AS (SELECT g.book_id, g.group_start, k, CASE WHEN k < 0 THEN 'Previous block ' || k || ': ' ELSE 'Next block +' || k || ': ' END || r.text t
  FROM (SELECT *, unnest([-2, -1, 1, 2]) k FROM g) g JOIN r ON r.book_id = g.book_id AND r.i = CASE WHEN k < 0 THEN a ELSE z END + k)
SELECT g.book_id, g.group_start, coalesce(string_agg(t, chr(10) ORDER BY k), '') AS context FROM g LEFT JOIN n USING (book_id, group_start) GROUP BY 1, 2""")
def group_contexts(spark, folder):
    rows = cut(grouped(spark, folder).select("book_id", "line_idx", "text", "group_start"))
    return answers.group_contexts(rows, rows, int(setting(spark, folder, "context_window")))


def group_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, group_start, line_idxs, texts, frame) of each group within the token budget: its prompt with a slot for the text; context
    at its ends, terms of text and context, place of its first line."""
    rows = sectioned(spark, folder)
    rows = cut(rows.join(answers.budget_groups(rows, int(setting(spark, folder, "llm_input_max_length")) // 2).drop("over"), ["book_id", "line_idx"]))
    window = int(setting(spark, folder, "context_window"))
    at_first = F.when(F.col("line_idx") == F.col("group_start"), F.struct("book_title", "chapter_heading", "file_name", "kind"))
    sided = answers.with_sides(rows.select("book_id", "line_idx", "group_start", "text", at_first.alias("first")), window)
    line = F.struct("line_idx", F.coalesce("text", F.lit("")).alias("text"))
    groups = sided.groupBy("book_id", "group_start").agg(F.array_sort(F.collect_list(line)).alias("rows"), F.max("first").alias("first"), answers.context_of_sides().alias("context"))
    found = terms.matched(rows, table(spark, folder, "term_memory"), window, unit="group_start")
    found = terms.section(found).withColumnRenamed("line_idx", "group_start")
    place = prompts.document_context(F.col("first.book_title"), F.col("first.chapter_heading"), F.col("first.file_name"), F.col("first.kind"))
    frame = prompts.render(F.lit(answers.SLOT), F.lit(setting(spark, folder, "llm_target_language")), F.col("context"), F.col("terminology"), place)
    return groups.join(found, ["book_id", "group_start"], "left").select("book_id", "group_start", F.transform("rows", lambda x: x["line_idx"]).alias("line_idxs"), F.transform("rows", lambda x: x["text"]).alias("texts"), frame.alias("frame"))


@query()
def prompt_groups(spark, folder):
    """The prompt of every group."""
    text = F.array_join(F.transform("texts", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return group_frames(spark, folder).select("book_id", "group_start", F.replace("frame", F.lit(answers.SLOT), text).alias("prompt"))


class SmallLetters:
    """A stand-in for a model: answers in small letters; of every group of five or more it forgets the last line, so that its lines are asked for singly."""

    def generate(self, prompts: list[str], max_new_tokens: int) -> list[str]:
        out = []
        for prompt in prompts:
            lines = re.split(r"\n(?=\[\d+\] )", "\n" + prompt.rsplit("Text:\n\n", 1)[1])[1:]
            out.append("\n".join(x.replace("\n", " ").lower() for x in (lines[:-1] if len(lines) >= 5 else lines)))
        return out


@query(f"WITH {LINES} SELECT book_id, line_idx, {_norm('lower(text)')} AS text FROM lines WHERE {_norm('coalesce(text, ' + repr('') + ')')} <> ''")
def answers_resolved(spark, folder):
    """Every line's answer, by group or singly, from a stand-in that answers in small letters; lines without text are not compared."""
    nothing = F.lit("")
    bare = prompts.render(F.lit(answers.SLOT), F.lit(setting(spark, folder, "llm_target_language")), nothing, nothing, nothing)
    records = group_frames(spark, folder).withColumn("bare", bare).withColumn("max_new_tokens", T.output_budget(F.lit(100), F.size("texts"), 2048).cast("int"))
    got = answers.resolve(records, SmallLetters, 16 * int(setting(spark, folder, "llm_input_max_length")))
    asked = source(spark, folder).filter(T.normalize_text(F.coalesce("text", F.lit(""))) != "").select("book_id", "line_idx")
    return got.join(asked, ["book_id", "line_idx"], "left_semi").select("book_id", "line_idx", T.normalize_text("text").alias("text"))


@query()
def prompt_render(spark, folder):
    """The prompt of every line by itself, with context, terms and place."""
    place = prompts.document_context(F.col("book_title"), F.col("chapter_heading"), F.col("file_name"), F.col("kind"))
    rows = sectioned(spark, folder).select("book_id", "line_idx", "text", place.alias("place"))
    rows = rows.join(terms.section(matched(spark, folder)), ["book_id", "line_idx"], "left")
    whole = grouping.with_context(rows, int(setting(spark, folder, "context_window")))
    return whole.select("book_id", "line_idx", prompts.render(F.col("text"), F.lit(setting(spark, folder, "llm_target_language")), F.col("context"), F.col("terminology"), F.col("place")).alias("prompt"))


@query(f"""WITH RECURSIVE {LINES}, {UNITS}, {SECTIONS}, {SEGMENTS}, {GROUPS}, {DONE},
g AS (SELECT f.book_id, f.line_idx, f.group_start, d.line_idx IS NOT NULL ok FROM fold f LEFT JOIN done d ON d.book_id = f.book_id AND d.line_idx = f.line_idx),
todo AS (SELECT book_id, line_idx, CASE WHEN part THEN line_idx ELSE group_start END AS group_start FROM (SELECT *, bool_or(ok) OVER (PARTITION BY book_id, group_start) part FROM g) WHERE NOT ok),
o AS (SELECT t.book_id, t.group_start, t.line_idx, coalesce(l.text, '') text, row_number() OVER (PARTITION BY t.book_id, t.group_start ORDER BY t.line_idx) i FROM todo t JOIN lines l ON l.book_id = t.book_id AND l.line_idx = t.line_idx),
r AS (SELECT book_id, group_start, CAST(count(*) AS INTEGER) AS lines, string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) AS numbered FROM o GROUP BY book_id, group_start),
k AS (SELECT *, CAST(ceil(length(numbered) / 4.0) AS INTEGER) AS token_count FROM r)
SELECT book_id, group_start, lines, token_count, CAST(least(2048, greatest(64, CAST(ceil(token_count * 1.6) AS INTEGER) + 32 + lines * 8)) AS INTEGER) AS max_new_tokens,
  CAST((row_number() OVER (PARTITION BY book_id ORDER BY token_count, group_start) - 1) // 4 AS INTEGER) AS batch FROM k""")
def translation_plan(spark, folder):
    """What is left to translate: groups with their size, answer budget and batch."""
    rows = cut(grouped(spark, folder).select("book_id", "line_idx", "text", "group_start"))
    todo = resume.regroup(rows.drop("text"), resume.completed(table(spark, folder, "resume_records"), rows.select("book_id", "line_idx")))
    records = grouping.numbered(todo.join(rows.select("book_id", "line_idx", "text"), ["book_id", "line_idx"])).withColumn("token_count", F.ceil(F.length("numbered") / 4.0).cast("int"))
    planned = records.withColumn("max_new_tokens", T.output_budget("token_count", "lines", 2048).cast("int"))
    return grouping.batches(planned, 4).select("book_id", "group_start", "lines", "token_count", "max_new_tokens", "batch")


def _split_sql() -> str:
    """Each step cuts one chunk off the rest: after the last of the strongest separator beyond a third, else at the limit."""
    at = lambda s, keep: f"CASE WHEN instr(w, {s}) > 0 AND length(w) - length({s}) - (instr(reverse(w), reverse({s})) - 1) >= m // 3 THEN length(w) - length({s}) - (instr(reverse(w), reverse({s})) - 1) + {keep} END"
    cuts = ", ".join(at(f"chr({ord(s)})" if len(s) == 1 else f"'{s}'", len(s.rstrip() or s)) for s in chunking.SEPARATORS)
    strip = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
    return f"""WITH RECURSIVE {LINES}, lim AS (SELECT CAST(value AS INTEGER) m FROM run_settings WHERE setting = 'llm_chunk_chars'),
long AS (SELECT book_id, line_idx, {strip('text')} t FROM lines, lim WHERE length(text) > m),
fold AS (SELECT book_id, line_idx, 0 k, CAST(NULL AS VARCHAR) chunk, t rest FROM long
  UNION ALL SELECT book_id, line_idx, k + 1, {strip('left(rest, c)')}, {strip('substr(rest, c + 1)')} FROM (
    SELECT *, CASE WHEN length(rest) <= m THEN length(rest) ELSE coalesce({cuts}, m) END c FROM (SELECT *, left(rest, m) w FROM fold, lim WHERE rest <> '')))
SELECT book_id, line_idx, CAST(row_number() OVER (PARTITION BY book_id, line_idx ORDER BY k) - 1 AS INTEGER) AS chunk_idx, chunk FROM fold WHERE k > 0 AND chunk <> ''
UNION ALL SELECT book_id, line_idx, 0, text FROM lines, lim WHERE length(text) <= m"""


@query(_split_sql())
def split_chars(spark, folder):
    most = int(setting(spark, folder, "llm_chunk_chars"))
    rows = source(spark, folder).filter("text is not null")
    return rows.select("book_id", "line_idx", F.posexplode(chunking.chunks_column("text", most)).alias("chunk_idx", "chunk"))


# --- metrics


_TOK = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(X), '([^\p{L}\p{N}_ ]|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}])', ' \1 ', 'g'), '[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"
_LAST_PAIRS = """SELECT * FROM eval_pairs QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY loaded_at DESC NULLS LAST, pred_path DESC NULLS LAST, line_idx DESC NULLS LAST, system DESC NULLS LAST, src_lang DESC NULLS LAST, target_lang DESC NULLS LAST, original_text DESC NULLS LAST, pred DESC NULLS LAST) = 1"""
# These tables hold one reference at most; the operators take several.
_PAIRS = f"""e AS (SELECT system, pair_id, {_TOK.replace('X', 'pred')} p, {_TOK.replace('X', 'refs[1]')} r FROM ({_LAST_PAIRS}) WHERE pred IS NOT NULL AND length(refs[1]) > 0)"""


def _gram_sql(side: str, n: int) -> str:
    gram = " || chr(1) || ".join(f"{side}[i + {k}]" for k in range(n))
    return f"SELECT pair_id, {gram} g, count(*) c FROM (SELECT pair_id, {side}, unnest(range(1, len({side}) - {n - 2})) i FROM e) GROUP BY 1, 2"


def _rouge_sql(n: int) -> str:
    return f"""WITH {_PAIRS}, a AS ({_gram_sql('p', n)}), b AS ({_gram_sql('r', n)}), m AS (SELECT pair_id, sum(least(a.c, b.c)) m FROM a JOIN b USING (pair_id, g) GROUP BY 1)
SELECT system, round(avg(coalesce(2 * m / nullif(greatest(len(p) - {n - 1}, 0) + greatest(len(r) - {n - 1}, 0), 0), 0)), 9) AS rouge FROM e LEFT JOIN m USING (pair_id) GROUP BY system"""


def _bleu_sql() -> str:
    parts = [f"a{n} AS ({_gram_sql('p', n)}), b{n} AS ({_gram_sql('r', n)}), m{n} AS (SELECT system, sum(least(a.c, coalesce(b.c, 0))) m, sum(a.c) t FROM a{n} a JOIN e USING (pair_id) LEFT JOIN b{n} b ON a.pair_id = b.pair_id AND a.g = b.g GROUP BY 1)" for n in (1, 2, 3, 4)]
    joins = " ".join(f"LEFT JOIN m{n} USING (system)" for n in (1, 2, 3, 4))
    logs = " + ".join(f"CASE WHEN m{n}.m > 0 THEN ln(m{n}.m / m{n}.t) END / 4" for n in (1, 2, 3, 4))
    return f"""WITH {_PAIRS}, s AS (SELECT system, count(*) pairs, sum(len(p)) pl, sum(len(r)) rl FROM e GROUP BY 1), {", ".join(parts)}
SELECT system, round(coalesce(exp({logs} + CASE WHEN pl >= rl THEN 0 ELSE 1 - rl / pl END), 0), 9) AS bleu, pairs FROM s {joins}"""


@query(_bleu_sql())
def bleu_corpus(spark, folder):
    return metrics.bleu(pairs(spark, folder)).withColumn("bleu", F.round("bleu", 9))


@query()
def sacrebleu_corpus(spark, folder):
    """With the tokens of mteval-v13a, smoothed, from 0 to 100."""
    return metrics.bleu(pairs(spark, folder), metrics.words_13a, smooth=True).withColumn("bleu", F.round(100 * F.col("bleu"), 6))


@query(_rouge_sql(1))
def rouge_1(spark, folder):
    return metrics.rouge(pairs(spark, folder), 1).withColumn("rouge", F.round("rouge", 9))


@query(_rouge_sql(2))
def rouge_2(spark, folder):
    return metrics.rouge(pairs(spark, folder), 2).withColumn("rouge", F.round("rouge", 9))


@query()
def sentence_metrics(spark, folder):
    return metrics.sentence_metrics(pairs(spark, folder))
