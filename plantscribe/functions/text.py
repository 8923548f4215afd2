"""Column functions over text: tokens, tags, keywords, keys and vectors. All stay inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# Words that the term index leaves out.
INDEX_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "have", "has", "do", "does", "did", "not", "this", "that", "it", "its",
)
# Words that incident keywords leave out.
KEYWORD_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "has", "have", "had", "this", "that", "it", "its", "failure", "failed", "issue", "problem",
)
# Keywords of title classes.
TITLE_CLASSES = {
    "regulation": ("regulation", "osha", "cfr", "code of federal", "standard", "ansi", "iso ", "api rp", "nfpa", "epa"),
    "procedure": ("sop", "procedure", "work instruction", "standard operating procedure", "checklist", "instructions"),
    "oem_manual": ("manual", "oem", "datasheet", "data sheet", "spec sheet", "specification", "installation guide", "operation guide", "service guide"),
}
# Equipment tag patterns and phrases of how-to questions.
TAG_PATTERNS = (r"[A-Z]{1,4}-\d+[A-Z]?", r"[A-Z]{1,4}\d{3,}[A-Z]?")
HOW_TO = ("how to", "how do i", "steps to", "procedure", "instructions", "walk me through")
WORK_ORDER = r"\bWO-\d+\b"

WORD = r"[^\x20\x09-\x0D]+"
TAG = rf"\b(?:{'|'.join(TAG_PATTERNS)})\b"


def words(text: Column) -> Column:
    """Words between ASCII white space; the engine's token unit."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _one_of(values: tuple[str, ...]) -> str:
    """A pattern of these words, those with one first letter together."""
    firsts = dict.fromkeys(v[0] for v in values)
    return "|".join(f"{f}(?:{'|'.join(v[1:] for v in values if v[0] == f)})" for f in firsts)


#: One pass of the pattern leaves stop words and single characters out; a filter over the tokens would run outside generated code.
INDEX_TOKEN = rf"(?<![a-z0-9_\-])(?!(?:{_one_of(INDEX_STOP_WORDS)})(?![a-z0-9_\-]))[a-z0-9_\-]{{2,}}+"


def index_tokens(text: Column) -> Column:
    """Lower-cased index terms without stop words and single characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(INDEX_TOKEN), F.lit(0))


def keywords(text: Column, limit: int = 6) -> Column:
    """The first distinct telling terms of an incident text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[A-Za-z0-9\-]+"), F.lit(0))
    stop = F.array(*map(F.lit, KEYWORD_STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(found, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))), 1, limit)


def tags(text: Column) -> Column:
    """Equipment tags in order, repeats included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TAG), F.lit(0))


def first_tag(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TAG, 0), F.lit(""))


def first_work_order(text: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(text, "(?i)" + WORK_ORDER, 0), F.lit("")))


def intent(text: Column) -> Column:
    """unknown, entity_lookup, procedural or document_search."""
    t = F.trim(F.coalesce(text, F.lit("")))
    how_to = r"(?i)\b(" + "|".join(HOW_TO) + r")\b"
    return F.when(t == "", "unknown").when(t.rlike(TAG), "entity_lookup").when(t.rlike(how_to), "procedural").otherwise("document_search")


def title_class(title: Column, kind: str) -> Column:
    return F.lower(F.coalesce(title, F.lit(""))).rlike("|".join(TITLE_CLASSES[kind]))


def title_stem(name: Column) -> Column:
    """A file name without folders and extension, trimmed, lower case."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*/", "")
    return F.lower(F.trim(F.regexp_replace(base, r"\.[^.]*$", "")))


def says_yes(answer: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(answer, F.lit("")), r"^[*_\-#\s]+", "")).startswith("yes")


def request_key(query: Column, scope: Column, k: Column) -> Column:
    """Key of a repeated question; unlike a key without ``k``, results of other sizes don't share it."""
    return F.sha2(F.concat_ws("|", query, scope, k.cast("string")), 256)


def approximate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    # The length goes through an array of one: within the inner function it would be summed up again for every element.
    over = lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
    return F.get(F.transform(F.array(F.sqrt(dot(v, v))), over), 0)


def unescape(text: Column) -> Column:
    """Named and numbered character references as the characters that they stand for; unknown ones stay."""
    names = F.from_json(F.lit(json.dumps({k[:-1]: v for k, v in html5.items() if k[-1] == ";"})), "map<string,string>")  # folded to one constant
    named = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    decimal = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    hexadecimal = F.array_distinct(F.regexp_extract_all(text, F.lit("&#[xX]([0-9a-fA-F]{1,6});"), F.lit(1)))

    def sign(code: Column) -> Column:
        usable = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(usable, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    out = F.aggregate(decimal, text, lambda t, m: F.replace(t, F.concat(F.lit("&#"), m, F.lit(";")), sign(m.cast("bigint"))))
    out = F.aggregate(hexadecimal, out, lambda t, m: F.regexp_replace(t, F.concat(F.lit("&#[xX]"), m, F.lit(";")), F.regexp_replace(sign(F.conv(m, 16, 10).cast("bigint")), F.lit(r"([\\\\$])"), F.lit(r"\\\\$1"))))
    known = F.filter(named, lambda m: (m != "amp") & names[m].isNotNull())
    out = F.aggregate(known, out, lambda t, m: F.replace(t, F.concat(F.lit("&"), m, F.lit(";")), names[m]))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))  # last: what it gives is no reference


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags, references resolved; trimmed lines; the page itself where nothing is left."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "\n")
    t = unescape(F.regexp_replace(t, r"<[^>]*>", "\n"))
    t = F.regexp_replace(t, r"[ \t\r\n]*\n[ \t\r\n]*", "\n")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), F.lit("")), html)


def indic_share(text: Column) -> Column:
    """Share of Devanagari and Tamil signs among the letters; null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.regexp_count(text, F.lit(r"[ऀ-ॿ஀-௿]")) / F.nullif(letters, F.lit(0))


def decode_bytes(content: Column) -> Column:
    """UTF-8 without its byte-order mark, else Latin-1; never fails."""
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    return F.coalesce(utf8, F.decode(content, "ISO-8859-1"))


def strip_fences(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, r"(?s)^.*?```[a-zA-Z]*\s*", ""), r"(?s)\s*```.*$", "")


def balanced_block(text: Column, opening: str = "[", closing: str = "]") -> Column:
    """From the first opening bracket to the closing one that balances it; null without. Brackets within strings count as well.

    The text is cut behind each bracket, so the walk has as many steps as there are brackets.
    """
    both = rf"\{opening}\{closing}"
    rest = F.regexp_extract(text, rf"(?s)\{opening}.*", 0)
    pieces = F.regexp_extract_all(rest, F.lit(rf"(?s)[^{both}]*[{both}]"), F.lit(0))
    none = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, piece: Column) -> Column:
        depth, at = s["depth"] + F.when(piece.endswith(opening), 1).otherwise(-1), s["at"] + F.length(piece)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(pieces, none, step, lambda s: s["end"])
    return F.when(end > 0, F.substring(rest, F.lit(1), end))


def noisy_json(answer: Column, opening: str = "[", closing: str = "]") -> Column:
    """JSON text in a model's answer: the answer itself, its first balanced bracket block, or what stands in a code fence.

    Empty results count as misses.
    """
    tried = [F.trim(answer), balanced_block(answer, opening, closing), F.trim(strip_fences(answer))]
    good = [F.when(F.try_parse_json(t).isNotNull() & t.startswith(opening) & ~F.regexp_replace(t, r"\s", "").isin("[]", "{}"), t) for t in tried]
    return F.coalesce(*good)


def hashed_dimension(token: Column, dimensions: int = 64) -> Column:
    """Dimension of a term in a vector that needs no model."""
    return (F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("int") % dimensions).cast("int")
