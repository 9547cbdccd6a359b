"""String functions as Columns: ids, paths, words, escapes, lengths.

A null argument gives null unless a docstring says otherwise.  Lengths are named for
their unit, since bytes and characters differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(s: Column) -> Column:
    """Lower case of A-Z only; ``lower`` would fold other scripts into a-z as well."""
    return F.translate(s, _UPPER, _LOWER)


def normalize_id(s: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, joined by '_'."""
    return F.btrim(F.regexp_replace(ascii_lower(s), "[^a-z0-9]+", "_"), F.lit("_"))


def make_id(*parts: Column) -> Column:
    """An id of several parts: '_' and '.' are trimmed from each, empty ones dropped, then runs of other characters become '_'."""
    trimmed = F.array(*[F.regexp_replace(p, r"^[_.]+|[_.]+$", "") for p in parts])
    joined = F.array_join(F.filter(trimmed, lambda x: x != ""), "_")
    return F.lower(F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_level_dir(path: Column) -> Column:
    """What precedes the first slash; the whole path without one."""
    return F.substring_index(path, "/", 1)


def file_extension(path: Column) -> Column:
    """Lower-case text after the last dot of the whole path, '' without a dot."""
    return F.when(F.instr(path, ".") > 0, F.lower(F.substring_index(path, ".", -1))).otherwise(F.lit(""))


def file_stem(path: Column) -> Column:
    """parent.stem of a path, or only the stem at the root."""
    name = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    parent = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    return F.when(F.instr(path, "/") > 0, F.concat_ws(".", F.when(parent != "", parent), name)).otherwise(name)


def forward_path(path: Column) -> Column:
    """A path with forward slashes and without leading './'."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def digest(h: Column) -> Column:
    """A hex digest without its notation: lower case, no algorithm name, no white space; null for nothing."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(h), r"(?U)\s+", ""), r"^[a-z0-9_-]*[:=]", "")
    return F.when(bare != "", bare)


def is_blank(s: Column) -> Column:
    return s.rlike(r"(?U)^[\s\x{FEFF}\x{200B}]*$")


def word_count(text: Column) -> Column:
    """Runs of non-white characters, white space as Unicode has it; null counts 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, at least 1, also for null."""
    return F.greatest(F.floor(F.octet_length(text) / 4).cast("bigint"), F.lit(1).cast("bigint"))


def strip_call(label: Column) -> Column:
    """A label without trailing '()'s."""
    return F.regexp_replace(label, r"(\(\))+$", "")


def capitalise(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def html_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def cypher_escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def yaml_string(s: Column) -> Column:
    s = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.regexp_replace(s, r"[\r\n]", " ")


def script_escape(s: Column) -> Column:
    """JSON text that can't close the script element around it."""
    return F.replace(s, F.lit("</"), F.lit("<\\/"))


def sanitize_label(label: Column, chars: int = 256) -> Column:
    """Without control characters, at most ``chars`` characters."""
    return F.substring(F.regexp_replace(label, r"[\x00-\x1F\x7F]", ""), 1, chars)


def byte_prefix(s: Column, n: int) -> Column:
    """The characters that fit into the first n bytes of UTF-8; one that would be cut is left out."""
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, n).cast("string"))
    # what is left of a cut character became a replacement character, which is longer or isn't in the text
    whole = F.startswith(s, cut) & (F.octet_length(cut) <= n)
    return F.when(F.octet_length(s) <= n, s).otherwise(F.when(whole, cut).otherwise(F.regexp_replace(cut, r"\x{FFFD}$", "")))


def render_label(label: Column, n: int = 256) -> Column:
    """A label for rendered text: without control characters of either range, at most n bytes of whole characters."""
    return byte_prefix(F.regexp_replace(label, r"\p{Cc}", ""), n)


def thousands(number: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(number.cast("bigint"), 0)


def url_component(s: Column) -> Column:
    """Percent-encoding of all but letters, digits and -_.~ of ASCII."""
    out = F.url_encode(s)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def safe_filename(url: Column, chars: int = 80) -> Column:
    r"""A file name of a URL: other than \w and - become single '_', trimmed, cut."""
    name = F.regexp_replace(F.regexp_replace(url, r"(?U)[^\w\-]", "_"), "_+", "_")
    return F.substring(F.regexp_replace(name, "^_+|_+$", ""), 1, chars)


def wiki_filename(label: Column) -> Column:
    """A file name of a label: slashes and colons '-', spaces and what file systems refuse '_'; 'unnamed' for nothing."""
    name = F.regexp_replace(F.translate(label, "/: ", "--_"), r'[\\*?"<>|#^\[\]\x00-\x1F]', "_")
    name = F.substring(F.regexp_replace(name, r"^[. ]+|[. ]+$", ""), 1, 200)
    return F.when(name == "", F.lit("unnamed")).otherwise(name)


def community_name(label: Column) -> Column:
    """A heading of a label: line ends become spaces, characters of links go, a Markdown suffix too; 'unnamed' for nothing."""
    name = F.trim(F.regexp_replace(F.regexp_replace(label, r"\r\n|\r|\n", " "), r'[\\/*?:"<>|#^\[\]]', ""))
    name = F.trim(F.regexp_replace(name, r"(?i)\.(mdx|md|markdown)$", ""))
    return F.when(name == "", F.lit("unnamed")).otherwise(name)
