"""Text predicates, cleaning and rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: what headings, captions, sections and secrets look like ----
HEADING = r"^(?:chapter|part|book|section)(?:$|[^\p{L}\p{N}_])"
HAN_NUMBER = "一二三四五六七八九十百0-9"
HAN_HEADING = f"^第[{HAN_NUMBER}]+[章节部篇卷]"
CAPTION = r"(?i)^(?:fig(?:ure)?|table|图|表)\s*[0-9一二三四五六七八九十.-]+"
STRUCTURE_WORDS = ("contents", "bibliography", "notes", "index", "acknowledgements", "glossary")
SECTION_WORDS = {
    "frontmatter": ("cover", "title page", "copyright", "dedication", "epigraph", "contents", "timeline", "maps", "序", "目录"),
    "notes": ("notes", "注释", "endnotes"),
    "bibliography": ("bibliography", "references", "works cited", "参考文献", "书目"),
    "index": ("index", "索引"),
    "acknowledgements": ("acknowledgements", "acknowledgments", "致谢"),
    "glossary": ("glossary", "characters", "术语", "人物"),
    "gallery": ("gallery", "plates", "illustrations", "图录", "插图"),
}
PART_DIVIDER = rf"^(?:part|book)\s+[ivxlcdm0-9]+(?:$|[^\p{{L}}\p{{N}}_])"
HAN_PART = f"^第[{HAN_NUMBER}]+[部篇卷]"
TOC_SIGNAL = r"(?i)^(?:chapter|part|book|section|introduction|conclusion|notes|bibliography|index)(?:$|[^\p{L}\p{N}_])"
NUMBERED = rf"^(?:[0-9]+\.|[IVXLCDM]+\.|第[{HAN_NUMBER}]+[章节部篇])"
SECRETS = (r"(?i)sk-[A-Za-z0-9_-]{16,}", r"(?i)api[_-]?key\s*[:=]\s*[A-Za-z0-9_-]{16,}", r"(?i)DEEPSEEK_API_KEY\s*=", r"(?i)OPENAI_API_KEY\s*=")
SCRIPTS = {
    "Arabic": r"[\x{0600}-\x{06FF}]",
    "Devanagari": r"[\x{0900}-\x{097F}]",
    "Han": r"[\x{3400}-\x{9FFF}]",
    "Hangul": r"[\x{AC00}-\x{D7AF}]",
    "Hebrew": r"[\x{0590}-\x{05FF}]",
    "Kana": r"[\x{3040}-\x{30FF}]",
    "Latin": r"\p{IsLatin}",
}
RECOGNISER_LANGUAGES = {"en": "eng", "zh": "chi_sim+eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "ja": "jpn", "ko": "kor", "ru": "rus"}
# ---- end of fixed values ----


def matches(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(pattern))


def collapse(value: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def kept_chars(value: Column, unwanted: str) -> Column:
    """How many characters remain without those that ``unwanted`` matches."""
    return F.length(F.regexp_replace(value, unwanted, ""))


def slug(value: Column, fallback: str = "book") -> Column:
    squeezed = F.regexp_replace(F.lower(strip(value)), r"[^a-z0-9\x{4E00}-\x{9FFF}]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(squeezed, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def heading_key(value: Column) -> Column:
    """Letters, digits and underscores, caseless."""
    return F.replace(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}\p{M}_]+", "")), F.lit("ß"), F.lit("ss"))


def display_heading(value: Column) -> Column:
    return strip(F.regexp_replace(value, r"\s+\[[A-Za-z0-9_.-]+\]$", ""))


def escape_markdown(value: Column) -> Column:
    """Lines that would read as headings or rules get a backslash."""
    heads = F.regexp_replace(value, r"(?m)^( {0,3})(#{1,6})(?=\s|$)", r"$1\\$2")
    return F.regexp_replace(heads, r"(?m)^( {0,3})((?:={3,}|-{3,}|\*{3,}|_{3,})[^\S\n]*)$", r"$1\\$2")


def table_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def repair_href(value: Column) -> Column:
    """Closing brackets at the end that nothing opens go."""
    href = strip(value)
    excess = (F.length(href) - F.length(F.replace(href, F.lit(")"), F.lit("")))) - (F.length(href) - F.length(F.replace(href, F.lit("("), F.lit(""))))
    tail = F.length(href) - F.length(F.regexp_replace(href, r"\)+$", ""))
    return F.substring(href, F.lit(1), F.length(href) - F.greatest(F.lit(0), F.least(excess, tail)))


def is_external(href: Column) -> Column:
    return matches(href, r"(?i)^(?:https?|mailto):")


def anchor_id(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9_.:-]+", "-")


def parent_number(title: Column) -> Column:
    """The number above a numbered heading's own: 2.3 of ``2.3.1 Title``; null without one."""
    number = F.regexp_extract(title, r"^\*?(\d+(?:\.\d+)+)(?:$|[^\p{L}\p{N}_])", 1)
    return F.nullif(F.regexp_replace(number, r"\.\d+$", ""), F.lit(""))


def strip_number(title: Column) -> Column:
    return F.regexp_replace(title, r"^[0-9]+\.\s*", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.[^.]+$", 0))


def fenced_code(text: Column, language: Column) -> Column:
    return F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), text, F.lit("\n```"))


def strip_list_marker(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(?:[-*•]|\d+[.)])\s+", "")


def renders_as_list_item(text: Column, kind: Column) -> Column:
    """Whether list markup applies: a year is no ordinal."""
    return F.coalesce(kind.isNotNull() & ~((kind == "ordered") & matches(text, r"^\d{4}[.)]\s+")), F.lit(False))


def is_secret(text: Column) -> Column:
    found = F.lit(False)
    for pattern in SECRETS:
        found = found | matches(text, pattern)
    return found


def scripts(text: Column) -> Column:
    """Sorted names of the scripts that occur."""
    return F.array_compact(F.array(*(F.when(matches(text, pattern), F.lit(name)) for name, pattern in SCRIPTS.items())))


def direction(text: Column) -> Column:
    """``rtl`` if over half of the letters belong to right-to-left scripts."""
    rtl = kept_chars(text, r"[^\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")
    return F.when(rtl * 2 > kept_chars(text, r"[^\p{L}]"), "rtl").otherwise("ltr")


def alnum_count(text: Column) -> Column:
    return kept_chars(text, r"[^\p{L}\p{N}]")


def cjk_ratio(text: Column) -> Column:
    """Share of common Han characters among those that aren't white space."""
    return kept_chars(text, r"[^\x{4E00}-\x{9FFF}]") / F.greatest(F.lit(1), kept_chars(text, r"(?U)\s"))


def symbol_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space."""
    return kept_chars(text, r"(?U)[\p{L}\p{N}\s]") / F.greatest(F.lit(1), F.length(text))


def is_garbled(text: Column, most: float = 0.45) -> Column:
    return F.contains(text, F.lit("�")) | (symbol_ratio(text) > most)


def is_usable(text: Column, least: int = 20) -> Column:
    """Enough letters and digits, and few replacement characters."""
    lost = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return (alnum_count(text) >= least) & (lost / F.greatest(F.lit(1), F.length(text)) < 0.01)


def is_plate_text(text: Column, confidence: Column, supplemental: Column) -> Column:
    """Whether text read off a plate is more than texture."""
    t = collapse(text)
    marked = supplemental & (matches(t, r"(?i)^[TI1]?SBN(?:$|[^\p{L}\p{N}_])") | matches(t, r"(?i)www\.|\.(?:edu|com|org)(?:$|[^\p{L}\p{N}_])"))
    least = F.when(marked, 0.20).otherwise(0.60)
    return F.coalesce((alnum_count(t) >= 4) & (alnum_count(t) / F.greatest(F.lit(1), F.length(t)) >= 0.55) & (confidence >= least), F.lit(False))


def block_kind(text: Column, tag: Column | None = None) -> Column:
    """heading_candidate, caption_candidate, table_candidate or text_candidate."""
    t, name = collapse(text), F.lower(F.coalesce(tag, F.lit(""))) if tag is not None else F.lit("")
    return (
        F.when(name.isin("h1", "h2", "h3", "h4", "h5", "h6") | matches(F.lower(t), HEADING) | matches(t, HAN_HEADING), "heading_candidate")
        .when(matches(t, CAPTION), "caption_candidate")
        .when(name.isin("table", "tr", "td", "th"), "table_candidate")
        .otherwise("text_candidate")
    )


def dom_block_kind(text: Column, tag: Column, ancestors: Column, css: Column, callout: Column, figure_caption: Column) -> Column:
    """The kind of a block with known ancestry."""
    t = collapse(text)
    low, within = F.lower(t), lambda name: F.coalesce(F.array_contains(ancestors, name), F.lit(False))
    structure = F.lit(False)
    for word in STRUCTURE_WORDS:
        structure = structure | F.contains(low, F.lit(word))
    return (
        F.when(tag == "math", "equation_candidate")
        .when(tag.isin("img", "image") & F.coalesce(callout, F.lit(False)), "callout_candidate")
        .when((tag == "pre") | within("pre"), "code_candidate")
        .when(tag.isin("td", "th", "caption") | within("table"), "table_candidate")
        .when(F.coalesce(figure_caption, F.lit(False)), "caption_candidate")
        .when(tag.isin("h1", "h2", "h3", "h4") | matches(low, HEADING) | matches(t, f"^第[{HAN_NUMBER}]+[章节部篇]"), "heading_candidate")
        .when(structure, "structure_candidate")
        .when(F.contains(F.coalesce(css, F.lit("")), F.lit("caption")) | (tag == "figcaption"), "caption_candidate")
        .otherwise("text_candidate")
    )


def section_type(title: Column) -> Column:
    """The first section whose words the title has, else a part divider or a chapter."""
    low, kind = F.lower(title), None
    for name, words in SECTION_WORDS.items():
        has = F.lit(False)
        for word in words:
            has = has | F.contains(low, F.lit(word))
        kind = F.when(has, name) if kind is None else kind.when(has, name)
    return kind.when(matches(low, PART_DIVIDER) | matches(title, HAN_PART), "part_divider").otherwise("body_chapter")


def is_toc_candidate(text: Column, kind: Column) -> Column:
    return (F.length(text) > 0) & (F.length(text) <= 90) & (matches(text, TOC_SIGNAL) | matches(text, NUMBERED) | kind.isin("heading_candidate", "structure_candidate"))


def recogniser_language(lang: Column) -> Column:
    """What a recogniser calls a language tag: by its first part, English without one, the part itself if it isn't known."""
    part = F.lower(F.substring_index(F.coalesce(F.nullif(lang, F.lit("")), F.lit("en")), "-", 1))
    known = F.create_map(*(F.lit(x) for pair in RECOGNISER_LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, part), part)
