"""Column functions on text. All are built-in expressions that stay in the JVM.

Whitespace and digits are Unicode-aware: U+3000 counts as a space and full-width
digits count as digits.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters counted as whitespace when text is stripped, and the
# ones a browser removes when it trims a form field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
FORM_WHITESPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_form_field(c: Column) -> Column:
    return F.btrim(c, F.lit(FORM_WHITESPACE))


def lines_of(c: Column) -> Column:
    """Stripped lines of a text; CRLF, CR and LF all end a line."""
    unified = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.transform(F.split(unified, "\n"), strip)


def fields_of(c: Column, sep: str = "  ") -> Column:
    """Fields between exactly ``sep``; empty fields are kept."""
    return F.split(c, rf"\Q{sep}\E")


def items_of(c: Column) -> Column:
    """Items separated by two or more whitespace characters, stripped, blanks dropped."""
    parts = F.transform(F.split(c, rf"(?U){SPACE_CLASS}{{2,}}"), strip)
    return F.filter(parts, lambda x: x != "")


def is_numbered(c: Column) -> Column:
    """The line starts with digits and a dot."""
    return c.rlike(r"(?U)^\d+\.")


def head_before(c: Column, mark: str) -> Column:
    """Text before the first ``mark``; all of it when there is none."""
    return F.split_part(c, F.lit(mark), F.lit(1))


def tail_after(c: Column, mark: str) -> Column:
    """All text after the first ``mark``; NULL when there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + F.lit(len(mark)), F.length(c)))


def piece_after(c: Column, mark: str) -> Column:
    """Text between the first and the second ``mark``; NULL when there is none."""
    return F.when(F.contains(c, F.lit(mark)), F.split_part(c, F.lit(mark), F.lit(2)))


def between(c: Column, first: str, second: str) -> Column:
    """Text after ``first``, cut before ``second`` inside that piece."""
    return head_before(piece_after(c, first), second)


def remove(c: Column, *parts: str) -> Column:
    for part in parts:
        c = F.replace(c, F.lit(part), F.lit(""))
    return c


def numbered_items(c: Column) -> Column:
    """Split on every run of digits and dots; empty items are dropped."""
    return F.filter(F.split(c, r"(?U)[\d.]+"), lambda x: x != "")


def file_stem(path: Column) -> Column:
    """File name up to its first dot."""
    return head_before(F.regexp_extract(path, r"[^/]+$", 0), ".")


def drop_special_tokens(c: Column) -> Column:
    return F.regexp_replace(c, r"<[|][a-z_]+[|]>", "")


def fill(template: str, value: Column) -> Column:
    """Put ``value`` where ``{}`` stands in ``template``."""
    before, after = template.split("{}")
    parts = [F.lit(p) for p in (before,) if p] + [value] + [F.lit(p) for p in (after,) if p]
    return F.concat(*parts)


def hash_number(*parts: Column) -> Column:
    """A number in 0 … 2^28-1 that depends only on the given values."""
    key = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("int")


# Rules for markup, applied in this order. Fixed values.
_DROPPED_MARKUP = r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->"
_BLOCK_MARKUP = r"(?i)<(?:br|/p|/div|/li|/ul|/h[1-6]|/title|/tr|/article|/nav|/footer|/body|p|div|h[1-6])(?:\s[^>]*)?/?>"
_ANY_MARKUP = r"(?s)<[^>]*>"
_ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]


def markup_to_text(c: Column) -> Column:
    """Readable text of an HTML page, one line per block element."""
    c = F.regexp_replace(c, _DROPPED_MARKUP, "")
    c = F.regexp_replace(c, _BLOCK_MARKUP, "\n")
    c = F.regexp_replace(c, _ANY_MARKUP, "")
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]*\n[ \t\n]*", "\n")
    return strip(c)
