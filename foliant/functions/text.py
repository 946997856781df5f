"""Column expressions on strings: tokens, names, titles, types. All stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

# The English stop words of keyword extraction.
STOP_WORDS = (
    "the and for with that this are was were has have had not but from into onto you your they them their will would should could can shall may might must "
    "about than then these those been being a an of to in on at by as is it its be do does did done or if when where how what which who whom whose there here "
    "also such more most some any all each both our his her he she we i me my so very just only too"
).split()
# File extensions by format class, MIME types by extension.
CLASSES = {
    "pdf": ["pdf"],
    "plain": ["txt", "text", "log", "csv", "tsv", "json", "xml", "yaml", "yml", "rtf"],
    "markdown": ["md", "markdown"],
    "docx": ["docx", "docm", "dotx", "dotm"],
    "odt": ["odt", "ott"],
    "email": ["eml", "msg"],
    "image": ["png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif", "heic", "webp"],
    "unsupported": ["doc", "xls", "xlsx", "ppt", "pptx", "odp", "ods"],
}
DOCX_MIME = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ODT_MIME = "application/vnd.oasis.opendocument.text"
CLASS_MIME = {"pdf": "application/pdf", "plain": "text/plain", "markdown": "text/markdown", "docx": DOCX_MIME, "odt": ODT_MIME, "email": "message/rfc822"}
IMAGE_MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "heic": "image/heic"}
MIME_EXTENSION = {
    "application/pdf": "pdf", "text/plain": "txt", "text/markdown": "md", "text/html": "html", DOCX_MIME: "docx", "application/msword": "doc", ODT_MIME: "odt", "application/rtf": "rtf",
    "application/epub+zip": "epub", "message/rfc822": "eml", "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/bmp": "bmp", "image/webp": "webp", "image/tiff": "tiff", "image/heic": "heic", "application/zip": "zip",
}
WORDS = r"([\p{IsAlphabetic}\p{N}]+)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c, pairs: dict[str, str], default: Column | None = None) -> Column:
    """A CASE over fixed pairs; without a match the default, else null."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    found = F.try_element_at(m, col(c))
    return found if default is None else F.coalesce(found, default)


def tokens_ascii(c) -> Column:
    """Tokenizer A: runs of letters and digits, A-Z lowered, without single characters and stop words."""
    lower = F.translate(F.coalesce(col(c), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.regexp_extract_all(lower, F.lit(WORDS), 1), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def tokens(c) -> Column:
    """Tokenizer B: runs of letters and digits, lowered."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORDS), 1)


def script(c) -> Column:
    """Cyrillic or Latin by the letters; Latin needs a Latin letter and no Cyrillic one."""
    c = F.coalesce(col(c), F.lit(""))
    cyr = F.length(F.regexp_replace(c, "[^Ѐ-ӿ]", ""))
    lat = F.length(F.regexp_replace(c, "[^A-Za-zÀ-ɏ]", ""))
    return F.when((cyr > 0) & (cyr >= lat), "Cyrillic").when((lat > 0) & (cyr == 0), "Latin").otherwise("Other")


def scripts_mismatch(a, b) -> Column:
    return (script(a) != script(b)) & (script(a) != "Other") & (script(b) != "Other")


def squeeze(c) -> Column:
    """White space to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\s+", " "), r"^ | $", "")


def excerpt(c, n: int = 240) -> Column:
    return F.left(squeeze(c), F.lit(n))


def shortened(c, n: int = 400) -> Column:
    """The first n characters, with an ellipsis where something is left out."""
    return F.when(F.length(squeeze(c)) > n, F.concat(F.left(squeeze(c), F.lit(n)), F.lit("…"))).otherwise(squeeze(c))


def preview(c, n: int = 2000) -> Column:
    """Bounded preview; null where the text is blank."""
    return F.when(~col(c).rlike(r"\S"), None).when(F.length(col(c)) > n, F.concat(F.left(col(c), F.lit(n)), F.lit("…"))).otherwise(col(c))


def sanitized(c) -> Column:
    """A file name: separators and illegal characters to blanks, joined by _, at most 120 characters, never empty."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"""[/\\:*?"<>|\n\r\t]""", " ")
    x = F.regexp_replace(F.regexp_replace(squeeze(x), " ", "_"), r"^[._]+|[._]+$", "")
    x = F.when(x == "", "document").otherwise(x)
    return F.when(F.length(x) > 120, F.concat(F.left(x, F.lit(117)), F.lit("..."))).otherwise(x)


def fs_stem(c) -> Column:
    """A stem for a file system: letters, digits and ' ._-()' kept, at most 80 characters, no reserved name."""
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^\p{IsAlphabetic}\p{N} ._()-]", "_")
    x = F.left(F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[_.\- ]+|[_.\- ]+$", ""), F.lit(80))
    return F.when(F.upper(F.substring_index(x, ".", 1)).rlike("^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$"), F.concat(F.lit("_"), x)).otherwise(x)


def ascii_stem(c) -> Column:
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^A-Za-z0-9._-]", "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[_.\-]+|[_.\-]+$", "")


def extension(c) -> Column:
    """What follows the last dot, lowered; the whole name where there is none."""
    return F.lower(F.substring_index(col(c), ".", -1))


def stem(c) -> Column:
    """The name without its extension; a name that only begins with a dot keeps it."""
    x = F.regexp_extract(col(c), r"^(.+)\.[^.]*$", 1)
    return F.when(x == "", col(c)).otherwise(x)


def original_extension(c) -> Column:
    """An extension of at most eight ASCII letters or digits, else null."""
    x = F.lower(F.regexp_extract(col(c), r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(x != "", x)


def format_class(ext) -> Column:
    return lookup(ext, {e: k for k, es in CLASSES.items() for e in es}, F.lit("unknown"))


def mime_for(ext, source) -> Column:
    k = format_class(ext)
    return F.coalesce(lookup(k, CLASS_MIME), lookup(ext, IMAGE_MIME), F.when(k.isin("unsupported", "unknown") & (col(source) == "plain"), "text/plain"), F.lit("application/octet-stream"))


def mime_extension(c) -> Column:
    return lookup(c, MIME_EXTENSION)


def file_name(title, original, mime, checksum) -> Column:
    """A friendly file name from the title, or 'document-' and the checksum's first eight digits where that has no usable character.

    The extension is the original name's, else the MIME type's; a title that ends with it loses its own.
    """
    ext = F.coalesce(original_extension(original), mime_extension(mime))
    none = F.concat(F.lit("document-"), F.coalesce(F.left(col(checksum), F.lit(8)), F.lit("")))
    base = F.coalesce(F.nullif(fs_stem(title), F.lit("")), none)
    cut = F.when(F.endswith(F.lower(base), F.concat(F.lit("."), ext)), F.left(base, F.length(base) - F.length(ext) - 1)).otherwise(base)
    return F.when(ext.isNull(), base).otherwise(F.concat(cut, F.lit("."), ext))


def safe_base_name(original, ident) -> Column:
    """The name of a temporary copy: the last part of the original name with ASCII letters, digits and ._- kept; 'document-<id>' without any."""
    none = F.concat(F.lit("document-"), col(ident))
    base = F.regexp_extract(F.coalesce(col(original), none), r"([^/\\\\]*)$", 1)
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^[_\\.]+", ""), r"[_\\.]+$", "")
    return F.when(kept == "", none).otherwise(kept)


def without_marks(c) -> Column:
    """A snippet without its marks."""
    return F.regexp_replace(col(c), "</?b>", "")


def centred_snippet(c, query: str, before: int = 70, after: int = 170) -> Column:
    """The text around the first place of a query, whatever its case, with an ellipsis where something is left out.

    A blank query gives an excerpt; one that isn't found counts as found at the beginning.
    """
    q = query.strip().lower()
    if not q:
        return excerpt(c)
    at = F.greatest(F.instr(F.lower(col(c)), q) - 1, F.lit(0))
    start, end = F.greatest(at - before, F.lit(0)), F.least(at + len(q) + after, F.length(col(c)))
    body = F.substr(col(c), start + 1, end - start)
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(col(c)), "…").otherwise(""))


def fnv32(c) -> Column:
    """FNV-1a over a string's UTF-16 code units, as a long: picks a tag's colour from a palette."""
    points = F.transform(F.filter(F.split(col(c), ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    units = F.flatten(F.transform(points, lambda u: F.when(u < 65536, F.array(u)).otherwise(F.array(F.floor((u - 65536) / 1024) + 55296, (u - 65536) % 1024 + 56320))))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF)))


def words_used(c) -> Column:
    """Number of words between white space, at least 1: how use of a model is counted."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda x: x != "")), F.lit(1))


def greatest_at(c) -> Column:
    """The first place, from 0, of an array's greatest value."""
    return F.array_position(col(c), F.array_max(col(c))) - 1


def rendered_title(keywords, most: int = 3) -> Column:
    """The first keywords, each with its first letter raised; 'document' without any."""
    words = F.filter(F.split(squeeze(F.array_join(F.slice(col(keywords), 1, most), " ")), " "), lambda w: w != "")
    up = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")
    return F.when(F.coalesce(up, F.lit("")) == "", "document").otherwise(up)


def rendered_filename(template: str, keywords, tags, title, date, ext) -> Column:
    """{keywords} {tags} {title} {date} {ext} filled in; lists give their first three, joined by -."""
    out = F.lit(template)
    for name, value in (("keywords", F.array_join(F.slice(col(keywords), 1, 3), "-")), ("tags", F.array_join(F.slice(col(tags), 1, 3), "-")), ("title", col(title)), ("date", col(date)), ("ext", col(ext))):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def trailing_separators(c) -> Column:
    return F.regexp_replace(col(c), r"[-_. ]+$", "")


def normalized_newlines(c) -> Column:
    """Lines without blanks at their ends, runs of blank lines as one, no newlines at the end."""
    x = F.regexp_replace(F.regexp_replace(col(c), "\r\n", "\n"), r"[^\S\n]+(?=\n|$)", "")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), "\n+$", "")


def relevance(c) -> Column:
    """A score in [0, 1]; what is not finite counts as 0."""
    x = col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rank_score(c) -> Column:
    return 1 / (1 + F.exp(col(c)))


def cosine_score(c) -> Column:
    return (col(c) + 1) / 2


def mime_category(c) -> Column:
    c = col(c)
    return F.when(c.isNull(), None).when(c == "application/pdf", "pdf").when(c.startswith("text/"), "text").when(c.startswith("image/"), "images").when(c.isin(DOCX_MIME, ODT_MIME), "documents").when(c == "message/rfc822", "email").otherwise("other")


def text_like(c) -> Column:
    return F.coalesce(col(c).rlike("^text/|json|xml|csv"), F.lit(False))


def preview_kind(mime, title) -> Column:
    m = F.lower(F.coalesce(col(mime), F.lit("")))
    return F.when(m.startswith("image/"), "image").when(m.isin("application/pdf", "application/x-pdf", "application/acrobat"), "pdf").when((m == DOCX_MIME) | F.lower(col(title)).rlike(r"\.docx$"), "docx")


def fork_id(ident, checksum) -> Column:
    return F.concat(col(ident), F.lit(".conflict."), F.left(col(checksum), F.lit(8)))
