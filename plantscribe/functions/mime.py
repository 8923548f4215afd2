"""File types by name, declaration and first bytes; admission and parser routing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File extension -> type.
EXTENSIONS = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xls": "application/vnd.ms-excel", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".txt": "text/plain", ".log": "text/plain", ".text": "text/plain", ".md": "text/markdown",
    ".markdown": "text/markdown", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json", ".xml": "application/xml", ".html": "text/html", ".htm": "text/html",
    ".yaml": "application/x-yaml", ".yml": "application/x-yaml", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff",
    ".tiff": "image/tiff", ".webp": "image/webp", ".eml": "message/rfc822", ".msg": "application/vnd.ms-outlook", ".zip": "application/zip",
}
# Declared types that tell nothing.
GENERIC = ("", "application/octet-stream", "binary/octet-stream", "application/binary")
# What is admitted, up to which size.
ALLOWED = (*dict.fromkeys(EXTENSIONS.values()), "text/xml")
MAX_BYTES = 100 << 20
# First bytes in hex -> type.
MAGIC = {"25504446": "application/pdf", "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "424D": "image/bmp", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "504B0304": "application/zip"}
# Parser -> the types that it takes.
PARSERS = {
    "text": ("text/plain",), "markdown": ("text/markdown",), "delimited": ("text/csv", "text/tab-separated-values"), "json": ("application/json",),
    "xml": ("application/xml", "text/xml"), "html": ("text/html",), "mail": ("message/rfc822",), "yaml": ("application/x-yaml",),
}


def sniff(head: Column) -> Column:
    """Type by the first bytes; null where they tell nothing."""
    code = F.hex(F.substring(head, 1, 8))
    out = F.when(head.isNull() | (F.length(head) == 0), F.lit(None).cast("string"))
    for magic, kind in MAGIC.items():
        out = out.when(code.startswith(magic), kind)
    text = F.ltrim(F.regexp_replace(F.decode(head, "ISO-8859-1"), r"^\s+", ""))
    return out.when(text.startswith("{") | text.startswith("["), "application/json").when(F.lower(F.substring(text, 1, 5)) == "<?xml", "application/xml")


def resolve(declared: Column, name: Column, head: Column) -> Column:
    """Extension first, then a specific declared type without its parameters, then the first bytes, then what is left."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/.](\.[^./]+)$", 1))
    specific = F.when(declared.isNotNull() & ~declared.isin(*GENERIC), F.trim(F.regexp_extract(declared, r"^[^;]*", 0)))
    return F.coalesce(F.try_element_at(table, extension), specific, sniff(head), F.nullif(declared, F.lit("")), F.lit("text/plain"))


def reject_reason(size: Column, mime: Column) -> Column:
    """Why an upload is refused; null where it is admitted."""
    return F.when(size == 0, "EMPTY_FILE").when(size > MAX_BYTES, "FILE_TOO_LARGE").when(~F.coalesce(mime.isin(*ALLOWED), F.lit(False)), "UNSUPPORTED_TYPE")


def parse_kind(mime: Column) -> Column:
    """The parser of a type; null where there is none, which is that document's failure."""
    out = F.when(mime.isNull(), F.lit(None).cast("string"))
    for kind, types in PARSERS.items():
        out = out.when(mime.isin(*types), kind)
    return out
