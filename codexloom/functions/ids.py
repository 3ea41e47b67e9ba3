"""Content-addressed identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(number: Column, digits: int) -> Column:
    """A number with zeros before it up to so many digits; a longer one stays whole."""
    t = number.cast("string")
    return F.lpad(t, F.greatest(F.lit(digits), F.length(t)), F.lit("0"))


def sha256(value: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes, lowercase hex."""
    return F.sha2(value, 256)


def short_sha(value: Column, digits: int = 16) -> Column:
    return F.substring(sha256(value), 1, digits)


def stable_id(prefix: str, *parts: Column | str, digits: int = 16) -> Column:
    """``prefix_`` and the first digits of the hash of the parts joined with bars. A null part reads ``None``."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), short_sha(F.concat_ws("|", *texts), digits))


def evidence_id(source_sha: Column, page_id: Column, engine: Column, ordinal: Column, text: Column) -> Column:
    """Identity of a text observation; one without a box prints it as ``[]``."""
    return stable_id("ev", source_sha, page_id, engine, ordinal, text, "[]")


def block_id(page_id: Column, evidence: Column) -> Column:
    return stable_id("blk", page_id, evidence)


def spans_json(block: Column, evidence: Column, start: Column, end: Column) -> Column:
    """The canonical JSON of one source span, keys sorted, with blanks after separators."""
    quoted = lambda name, value: F.concat(F.lit(f'"{name}": "'), value, F.lit('"'))
    number = lambda name, value: F.concat(F.lit(f'"{name}": '), value.cast("string"))
    return F.concat(F.lit("[{"), F.concat_ws(", ", quoted("block_id", block), number("end_offset", end), quoted("evidence_id", evidence), number("start_offset", start)), F.lit("}]"))


def paragraph_id(spans: Column) -> Column:
    return F.concat(F.lit("para_"), short_sha(spans))


def chunk_id(paragraph: Column, text_sha: Column) -> Column:
    return F.concat(F.lit("chunk_"), short_sha(F.concat(paragraph, text_sha)))


def heading_toc_id(paragraph: Column) -> Column:
    return F.concat(F.lit("toc_"), short_sha(paragraph, 12))


_CONTROL = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"} | {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in "\b\f\n\r\t"}


def json_string(value: Column) -> Column:
    """A string as JSON, with only what must be escaped escaped; the control characters' rules run only where one stands."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for char, shown in _CONTROL.items():
        full = F.replace(full, F.lit(char), F.lit(shown))
    return F.concat(F.lit('"'), F.when(F.rlike(value, F.lit(r"[\x00-\x1f]")), full).otherwise(plain), F.lit('"'))


def json_number(value: Column) -> Column:
    """A double as JSON with the fewest digits: plain between 1e-4 and 1e16, with a signed exponent of two digits or more beyond."""
    t, size = value.cast("double").cast("string"), F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(t.cast("decimal(38,21)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    mantissa, power = F.regexp_replace(F.substring_index(t, "E", 1), r"\.0$", ""), F.substring_index(t, "E", -1).cast("int")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), padded(F.abs(power), 2))
    small = (size >= 1e-4) & (size < 1e16)
    return F.when(F.isnan(value), "NaN").when(size == float("inf"), F.when(value > 0, "Infinity").otherwise("-Infinity")).when(value == 0, t).when(small & ~F.contains(t, F.lit("E")), t).when(small, plain).otherwise(F.concat(mantissa, F.lit("e"), exponent))


def json_value(value: Column, kind: str) -> Column:
    """A column of a simple type as JSON; ``null`` for a null."""
    shown = value.cast("string") if kind in ("boolean", "tinyint", "smallint", "int", "bigint") or kind.startswith("decimal") else json_number(value) if kind in ("float", "double") else json_string(value.cast("string"))
    return F.coalesce(shown, F.lit("null"))


def row_json(kinds: dict[str, str], names: list[str]) -> Column:
    """A row's fields as JSON with sorted keys and blanks after separators; nulls stay. ``kinds``: each column's type name."""
    fields = [F.concat(json_string(F.lit(n)), F.lit(": "), json_value(F.col(f"`{n}`"), kinds[n])) for n in sorted(names)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))


def rows_digest(line: Column) -> Column:
    """Digest of many lines whatever their order: SHA-256 of the sums of the lines' SHA-256 words and their number. An aggregate of fixed
    size that combines on the map side; a change of any line changes it, and 256 bits keep it from being forged."""
    sha = sha256(line)
    words = [F.sum(F.conv(F.substring(sha, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")) for k in range(8)]
    return sha256(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(F.coalesce(w, F.lit(0)).cast("string") for w in words)))


def set_digest(rows: Column) -> Column:
    """Digest of a set of lines: they are sorted and joined with newlines. An aggregate, one hash a group."""
    return sha256(F.array_join(F.sort_array(F.collect_list(rows)), "\n"))
