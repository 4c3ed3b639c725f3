"""String functions as native column expressions. Space and word classes are written out: the engines' shorthands are ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
TRIM = r"^[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+|[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+$"

LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Fixed values
STRUCTURAL_RESIDUES = ("body", "head", "html", "xhtml")
ROMAN_PAGES = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")
ECHOES = (
    "preserve all information", "do not summarize", "do not explain", "do not omit content", "document context for consistency only",
    "context for consistency only", "terminology memory for consistency", "locked terminology for consistency", "保留所有信息", "不要总结", "不要解释",
    "不要遗漏内容", "仅用于保持一致性的文档背景", "仅用于保持一致性的上下文", "用于保持一致性的术语记忆", "锁定术语",
)
LEAK_MARKERS = ("requirements:", *ECHOES, "块类型：", "块类型:")
CHINESE_CODES = {
    "zh-cn": ("zh-CN", "zh", "zh-Hans", "zh_CN", "zh_Hans", "cmn"),
    "zh-hans": ("zh-Hans", "zh", "zh-CN", "zh_CN", "zh_Hans", "cmn"),
    "zh-tw": ("zh-TW", "zh", "zh-Hant", "zh_TW", "zh_Hant", "cmn"),
    "zh-hant": ("zh-Hant", "zh", "zh-TW", "zh_TW", "zh_Hant", "cmn"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.btrim(F.regexp_replace(_col(c), WS + "+", " "), F.lit(" "))


def normalize_source_text(c: Column | str) -> Column:
    """As normalize_text, without blanks before closing and after opening punctuation."""
    out = F.regexp_replace(normalize_text(c), r" +([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"([(\[{]) +", "$1"), r" +([)\]}])", "$1")


def normalize_output_text(c: Column | str) -> Column:
    """As normalize_text, without blanks around full-width punctuation and between Chinese characters (pairs taken without overlap)."""
    out = F.regexp_replace(normalize_text(c), " +([，。！？；：、）】》」』])", "$1")
    return F.regexp_replace(F.regexp_replace(out, "([（【《「『]) +", "$1"), r"([\x{4e00}-\x{9fff}]) +([\x{4e00}-\x{9fff}])", "$1$2")


def encode_string(c: Column | str) -> Column:
    """Line breaks and tabs as two-character escapes, so that a text takes one line of a file."""
    out = _col(c)
    for raw, escape in (("\r", r"\r"), ("\n", r"\n"), ("\t", r"\t")):
        out = F.replace(out, F.lit(raw), F.lit(escape))
    return out


def reject_reason(c: Column | str) -> Column:
    """Why a text is not translatable, null if it is. Null texts are 'empty'."""
    t = F.coalesce(normalize_text(c), F.lit(""))
    low = F.lower(t)
    return (
        F.when(t == "", "empty")
        .when(low.isin(*STRUCTURAL_RESIDUES), "markup")
        .when(t.rlike(r"(?i)^(\?|<\?)?xml($|[^\p{L}\p{N}_])"), "xml declaration")
        .when(t.rlike(r"(?i)^(https?://|www\.)[^\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+$"), "url")
        .when(t.rlike(r"^[\[(]?[0-9]{1,4}[\])]?\.?$"), "number")
        .when(F.lower(F.btrim(t, F.lit("[](){}.,;:"))).isin(*ROMAN_PAGES), "roman page")
        .when(t.rlike(r"^[^\p{L}\p{N}]+$"), "punctuation")
    )


def is_translatable(c: Column | str) -> Column:
    return reject_reason(c).isNull()


def is_note_marker(c: Column | str) -> Column:
    """A note number in optional brackets, or a note word with its number."""
    t = F.lower(normalize_text(c))
    return t.rlike(r"^[\[(]?[0-9]{1,4}[\])]?\.?$") | t.rlike(r"^(fn|note|footnote|endnote)[-_ ]?[0-9]{1,5}\.?$")


def has_prompt_leak(c: Column | str) -> Column:
    """Whether a model's output echoes the prompt."""
    t = F.lower(F.replace(F.replace(F.coalesce(_col(c), F.lit("")), F.lit(r"\n"), F.lit("\n")), F.lit(r"\r"), F.lit("\n")))
    starts = "".join(sorted({m[0] for m in LEAK_MARKERS}))  # all markers in one pass over the text
    return t.rlike(f"(?=[{starts}])(?:" + "|".join(rf"\Q{m}\E" for m in LEAK_MARKERS) + ")")


def compact(c: Column | str, limit: int) -> Column:
    """White space collapsed; longer texts are cut to limit - 1 characters, stripped, and dotted."""
    t = normalize_text(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("...")))


def language_codes(c: Column | str) -> Column:
    """Ordered distinct spellings under which a model may know a language code; null and blank codes have none."""
    raw = F.trim(_col(c))
    alias = F.create_map(*[x for k, v in CHINESE_CODES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.coalesce(F.try_element_at(alias, F.replace(F.lower(raw), F.lit("_"), F.lit("-"))), F.array().cast("array<string>"))
    base = F.when(raw.rlike("[-_]"), F.array(F.regexp_extract(raw, "^([^-_]*)", 1))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.array(raw, F.replace(raw, F.lit("_"), F.lit("-")), F.replace(raw, F.lit("-"), F.lit("_"))), more, base)
    return F.when(F.coalesce(raw, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(every, lambda x: x != "")))


def epub_language(c: Column | str) -> Column:
    """Traditional Chinese is zh-Hant, every other target zh-Hans."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    return F.when(F.contains(t, F.lit("chinese")) & F.contains(t, F.lit("traditional")), "zh-Hant").otherwise("zh-Hans")


def output_budget(tokens: Column | str, group: Column | str, most: int) -> Column:
    """Tokens a model may answer with."""
    t, g, m = _col(tokens), _col(group), F.lit(most)
    return F.least(m, F.greatest(F.least(F.lit(64), m), (F.ceil(t * 1.6) + 32 + g * 8).cast("int")))
