"""Web pages, papers and answers as Markdown documents; URLs and their safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BLOCKED_HOSTS, SPEECH_HINT, URL_SCHEMES
from ..functions.text import safe_filename, yaml_string


def url_path(url: Column) -> Column:
    """The path of a URL without query and fragment, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1))


def url_host(url: Column) -> Column:
    """The host of a URL without user and port, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def url_type(url: Column) -> Column:
    """Kind of a URL by substrings of the whole of it (so that 'netflix.com' counts as 'x.com'), then by its path's suffix."""
    u = F.lower(url)
    return (
        F.when(u.contains("twitter.com") | u.contains("x.com"), "tweet").when(u.contains("arxiv.org"), "arxiv").when(u.contains("github.com"), "github")
        .when(u.contains("youtube.com") | u.contains("youtu.be"), "youtube").when(url_path(url).endswith(".pdf"), "pdf")
        .when(url_path(url).rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def url_type_strict(url: Column) -> Column:
    """``url_type`` by the host itself."""
    h = url_host(url)
    of = lambda *names: h.rlike(r"(^|\.)(" + "|".join(n.replace(".", r"\.") for n in names) + ")$")
    return (
        F.when(of("twitter.com", "x.com"), "tweet").when(of("arxiv.org"), "arxiv").when(of("github.com"), "github").when(of("youtube.com", "youtu.be"), "youtube")
        .when(url_path(url).endswith(".pdf"), "pdf").when(url_path(url).rlike(r"\.(png|jpg|jpeg|webp|gif)$"), "image").otherwise("webpage")
    )


def is_url(s: Column) -> Column:
    return s.rlike(r"^(https?://|www\.)")


def unsafe_url(url: Column) -> Column:
    """Why a URL mustn't be fetched, null if nothing speaks against it: scheme, metadata host or literal internal address.  Names aren't resolved."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][\w+.-]*):", 1)), url_host(url)
    o = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in (1, 2)]
    v4 = (
        o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & o[1].isin(168)) | ((o[0] == 169) & (o[1] == 254))
        | ((o[0] == 100) & o[1].between(64, 127)) | host.rlike(r"^192\.0\.0\.\d+$") | host.rlike(r"^(192\.0\.2|198\.51\.100|203\.0\.113)\.\d+$")
    )
    v6 = host.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*)\]$")
    return (
        F.when(~scheme.isin(*URL_SCHEMES), "scheme").when(host == "", "host").when(host.isin(*BLOCKED_HOSTS), "metadata host")
        .when(F.coalesce(v4, F.lit(False)) | v6 | (host == "localhost"), "internal address")
    )


def html_to_text(html: Column, chars: int = 8000) -> Column:
    """Page text without scripts, styles and tags, white space collapsed, the first ``chars`` characters; entities stay."""
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?is)<style[^>]*>.*?</style>", " "), r"<[^>]+>", " ")
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"^\s+|\s+$", ""), 1, chars)


def html_title(html: Column, url: Column) -> Column:
    """The first title, white space collapsed; the URL without one."""
    t = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(t == "", url).otherwise(t)


def arxiv_id(url: Column) -> Column:
    """The paper's number, null without one."""
    x = F.regexp_extract(url, r"(\d{4}\.\d{4,5})", 1)
    return F.when(x != "", x)


def page_documents(pages: DataFrame, contributor: str = "unknown") -> DataFrame:
    """(url, document) of pages (url, html): Markdown with front matter, the body cut at 12,000 characters."""
    title, q = html_title(F.col("html"), F.col("url")), lambda c: F.concat(F.lit('"'), yaml_string(c), F.lit('"'))
    head = F.concat(F.lit("---\nsource_url: "), q(F.col("url")), F.lit("\ntype: "), url_type(F.col("url")), F.lit("\ntitle: "), q(title), F.lit("\ncontributor: "), q(F.lit(contributor)), F.lit("\n---\n\n# "), title, F.lit("\n\n"))
    return pages.select("url", F.concat(head, F.substring(html_to_text(F.col("html"), 12_000), 1, 12_000), F.lit("\n")).alias("document"))


def _document(fields: list[tuple[str, Column]], body: list[Column]) -> Column:
    """Front matter of quoted values, then a Markdown body."""
    head = [F.concat(F.lit(f'{k}: "'), yaml_string(F.coalesce(v, F.lit(""))), F.lit('"\n')) for k, v in fields]
    return F.concat(F.lit("---\n"), *head, F.lit("---\n\n"), *[F.coalesce(c, F.lit("")) for c in body])


def post_documents(posts: DataFrame, contributor: str = "unknown") -> DataFrame:
    """(url, document) of short posts (url, answer): ``answer`` is the embedding service's JSON with html and author_name.

    An answer that is no such JSON, or null, gives a document that says so; its author is 'unknown'.
    """
    a = F.from_json("answer", "html string, author_name string")
    known = F.try_parse_json("answer").isNotNull()
    text = F.trim(F.regexp_replace(F.coalesce(a["html"], F.lit("")), r"<[^>]+>", ""))
    said = F.when(F.col("answer").isNull(), F.concat(F.lit("Post at "), "url", F.lit(" (not fetched)"))).when(~known, F.concat(F.lit("Post at "), "url", F.lit(" (answer not understood)"))).otherwise(text)
    author = F.coalesce(a["author_name"], F.lit("unknown"))
    fields = [("source_url", F.col("url")), ("type", F.lit("tweet")), ("author", author), ("contributor", F.lit(contributor))]
    return posts.select("url", _document(fields, [F.lit("# Post by @"), author, F.lit("\n\n"), said, F.lit("\n\nSource: "), F.col("url"), F.lit("\n")]).alias("document"))


def paper_documents(pages: DataFrame, contributor: str = "unknown") -> DataFrame:
    """(url, name, document) of a paper server's abstract pages (url, html): title, authors and abstract by their elements' classes.

    A page without a title gets the paper's number as one.  Addresses without a number are documents of
    ``page_documents``, named by their address.
    """
    inner = lambda pattern, gap: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", "(?si)" + pattern, 1), r"<[^>]+>", gap), r"\s+", " "))
    number = arxiv_id(F.col("url"))
    title, authors = inner(r'class="title[^"]*"[^>]*>(.*?)</h1>', " "), inner(r'class="authors"[^>]*>(.*?)</div>', "")
    abstract = F.trim(F.regexp_replace(F.regexp_extract("html", r'(?si)class="abstract[^"]*"[^>]*>(.*?)</blockquote>', 1), r"<[^>]+>", ""))
    named = F.when(F.coalesce(title, F.lit("")) == "", number).otherwise(title)
    fields = [("source_url", F.col("url")), ("arxiv_id", number), ("type", F.lit("paper")), ("title", named), ("paper_authors", authors), ("contributor", F.lit(contributor))]
    body = [F.lit("# "), named, F.lit("\n\n**Authors:** "), authors, F.lit("\n**arXiv:** "), number, F.lit("\n\n## Abstract\n\n"), abstract, F.lit("\n\nSource: "), F.col("url"), F.lit("\n")]
    papers = pages.where(number.isNotNull()).select("url", F.concat(F.lit("arxiv_"), F.replace(number, F.lit("."), F.lit("_"))).alias("name"), _document(fields, body).alias("document"))
    others = page_documents(pages.where(number.isNull()), contributor).select("url", safe_filename(F.col("url")).alias("name"), "document")
    return papers.unionByName(others)


def front_matter(text: Column, key: str) -> Column:
    """A value of a document's front matter, without quotes; null if it has none."""
    v = F.regexp_extract(F.regexp_extract(text, r"^---\r?\n(?s:(.*?))\r?\n---", 1), rf"(?m)^{key}: *(.*?)\r?$", 1)
    return F.when(v != "", F.regexp_replace(v, '^"|"$', ""))


def body_without_front_matter(text: Column) -> Column:
    """A Markdown text after its front matter."""
    return F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---[ \t]*(\r?\n|$)", "")


def file_hash(content: Column, rel_path: Column) -> Column:
    """SHA-256 of content, a zero byte and the relative path; Markdown counts without its front matter."""
    text = F.when(F.lower(rel_path).endswith(".md"), body_without_front_matter(content)).otherwise(content)
    return F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00")), F.encode(rel_path, "UTF-8")), 256)


def transcript_prompt(hubs: DataFrame, override: str | None = None) -> DataFrame:
    """One row: a hint for speech recognition from the first five hub labels, or ``override`` as it is; without hubs the general part."""
    if override:
        return hubs.sparkSession.createDataFrame([(override,)], "prompt string")
    first = hubs.where("label <> ''").orderBy("ord").limit(5)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), ", ")
    return first.agg(F.when(names == "", SPEECH_HINT[1]).otherwise(F.concat(F.lit(SPEECH_HINT[0]), names, F.lit(". "), F.lit(SPEECH_HINT[1]))).alias("prompt"))


def answer_documents(answers: DataFrame) -> DataFrame:
    """(slug, document) of answers (question, answer, kind, nodes): Markdown with front matter, at most ten nodes in it."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("question"), r"[^\w]+", "_"), "^_+|_+$", ""), 1, 50)
    nodes = F.concat(F.lit("["), F.array_join(F.slice("nodes", 1, 10), ", "), F.lit("]"))
    doc = F.concat(F.lit("---\ntype: "), "kind", F.lit('\nquestion: "'), yaml_string(F.col("question")), F.lit('"\nnodes: '), nodes, F.lit("\n---\n\n# Answer\n\n"), "answer", F.lit("\n"))
    return answers.select(slug.alias("slug"), doc.alias("document"))
