"""Problem 3: generated, minified, vendored files and data kept as code.

A Re-Pair grammar is inferred over every file's token sequence, all files of a batch
at once: in each round every pair of symbols that is more frequent in its file than
its neighbours becomes a rule.  A file that shrinks to few symbols was produced by
a tool.  Literals in long runs that such a grammar hardly shrinks are data.  A second
grammar chooses pairs by their content alone, so that equal passages get equal rules
in every file: rules shared with the library files show copies wherever they lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import written
from .languages import language
from .syntax import extension

#: Below this share of symbols left by the grammar, a file of at least MIN_TOKENS is output of a tool.
REUSE, MIN_TOKENS = 0.4, 60
#: Rounds of the second grammar, whose rules then span about ten tokens: the grain at which passages are compared.
SHARED_ROUNDS = 6
#: Tokens under a rule from which it is long enough to tell a passage that repos share.
SHARED_SPAN = 8
#: A run of so many literals, or of literals of so many characters, is data; a file with this share of its code in such runs is a blob.
RUN, LONG_LITERAL, BLOB = 8, 300, 0.5
#: From this ratio on a grammar over the literals counts as near-incompressible.
INCOMPRESSIBLE = 0.6
#: Minified: so little white space and so short names, or so many tokens a line.
MIN_WHITE, MIN_NAME, MIN_PER_LINE = 0.12, 3.5, 40
#: Share of a library file's rules, by tokens, from which a file is a copy of it in substance.
COPIED = 0.5
#: Rules of library files that are sent to every task (8 bytes each); more are joined instead.
MAX_SHARED_RULES = 2_000_000

# Directories for copies of third parties; the second group only with a library's own directory below.
VENDOR_DIRS = ("vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "Godeps", "site-packages")
VENDOR_PARENTS = ("external", "externals", "extern", "deps", "contrib")
# Names that tools give their output.
TOOL_NAMES = (
    r"_pb2(_grpc)?\.pyi?$|\.pb\.(go|cc|h|c)$|\.g(en)?\.(ts|js|go|rs|dart|py)$|_generated\.\w+$|\.generated\.\w+$|AutoTypes\.java$|\.(tab|yy)\.c$|\.designer\.\w+$|[.-]min\.js$|\.d\.ts\.map$"
)
# How tools sign what they write, in several languages; quoted words don't count.
SIGNATURES = (
    r"@generated\b|<auto-?generated|\bauto-?generated\s+(file|code|on|by|from)\b|\bgenerated code\b.{0,12}\bedits?\b|\bcode generated (by|from)\b"
    r"|\b(automatically|machine)[- ](created|generated|produced|built|written|made)\b|\b(file|code) (was|is) (automatically )?(produced|generated|created|written) (by|from)\b"
    r"|\bgenerated (by|from) \S+.{0,60}\b(do not|don't|never)\b|\b(do not|don't|please do not|never) (edit|modify|change|touch) (by hand|manually|directly)\b|\bdo not edit\b|\bmanual changes will be\b"
    r"|\bsource: \S+\s+\(written by the \S+ (compiler|generator|tool)\)|\boutput of \S+ *(v?[\d.]+)?; *do not\b"
    r"|(créé|généré|produit)\w* automatiquement|ne pas (modifier|éditer)|\bautomatisch\b.{0,60}\b(erzeugt|generiert|erstellt)\b|nicht (bearbeiten|ändern|editieren)\b"
    r"|(generado|creado|producido) autom[aá]ticamente|no (editar|modificar)\b|(gerado|criado) automaticamente|não (editar|modificar)|(generato|creato) automaticamente|non modificare"
    r"|(создан|сгенерирован|сформирован)\w* автоматически|автоматически (создан|сгенерирован|сформирован)|не (редактировать|изменять|править)|自動生成|自动生成|編集しないで|请勿(编辑|修改)|不要(编辑|修改)"
)

#: Comments, blank space, a docstring and a package's name before the first code, of any length; lines with a hash only where
#: it opens no directive, lines with a star as what a broken comment leaves, fences and conflict marks as what a broken file begins with.
_LEADING = {
    hashed: re.compile(r"\ufeff?(?:<\?(?:php\b|xml[^>]*\?>))?(?:\s+|//[^\n]*|--[^\n]*|;[^\n]*|/\*[\s\S]*?\*/|\*[^\n]*|<!--[\s\S]*?-->|[rRuU]?\"{3}[\s\S]*?\"{3}|[rRuU]?'{3}[\s\S]*?'{3}|package[ \t]+[\w.]+[ \t]*;?(?=\s)|(?:`{3}|<{7}|={7}|>{7})[^\n]*" + (r"|\#[^\n]*" if hashed else "") + ")*")
    for hashed in (True, False)
}
DIRECTIVES = ("c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "cs", "m", "mm")
_DOCSTRING = re.compile(r"[rRuU]?(\"{3}|'{3})([\s\S]*?)\1")

_MASK = (1 << 63) - 1
SKIP, NAME, CODE, LITERAL, BETWEEN, LINE = range(6)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) & _MASK or 1


class _Lexicon(dict):
    """lexeme -> row of the arrays below; one per language and worker."""

    LIMIT = 400_000

    def __init__(self, lang):
        super().__init__()
        self.lang = lang
        self.digits = str.maketrans("123456789", "0" * 9)
        self.reset()

    def reset(self):
        self.clear()
        self.kinds, self.sizes, self.shapes, self.raws = [], [], [], []

    def __missing__(self, x):
        c = self.lang.classify(x) if x else ""
        if x[:1] == "\n":
            kind = LINE
        elif not x or c in ("", "\n") or x[:2] in ("//", "/*"):
            kind = SKIP
        elif c in ("STR", "NUM", "CHAR", "TMPL") or c == "ERR" and x[0] in "\"'`0123456789":
            kind = LITERAL
        elif x in ",[]{}()-+:":
            kind = BETWEEN
        elif c == "IDENT":
            kind = NAME
        else:
            kind = CODE
        i = self[x] = len(self.kinds)
        shape = x.translate(self.digits)
        if kind == LITERAL and c == "NUM":
            shape = "0"
        while "00" in shape:
            shape = shape.replace("00", "0")
        self.kinds.append(kind)
        self.sizes.append(len(x.strip()))
        self.shapes.append(_hash(shape))
        self.raws.append(_hash(x))
        return i


_LEXICONS: dict[str, _Lexicon] = {}


def _read(ext: str, body: str) -> tuple[np.ndarray, _Lexicon]:
    """A file's lexemes as rows of its language's lexicon."""
    lang = language(ext) or language("c")
    lex = _LEXICONS.get(lang.name)
    if lex is None:
        lex = _LEXICONS[lang.name] = _Lexicon(lang)
    found = lang.lexemes(body.replace("\r\n", "\n").replace("\r", "\n"))
    at = np.fromiter(map(lex.__getitem__, found), dtype=np.int64, count=len(found))
    return at, lex


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 63-bit hash of pairs, the same everywhere."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x & np.uint64(_MASK)).astype(np.int64)


def grammar_sizes(symbols: np.ndarray, owner: np.ndarray, n_owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left and rules made by Re-Pair for the sequence of every owner; ``owner`` is in order.

    Pairs become rules in the order of their frequency in the file, ties by their hash, until none
    repeats.  A pair's occurrence is replaced as soon as neither neighbour overlaps it with a more
    frequent pair, so pairs that don't touch are replaced in one sweep.  Files don't influence each
    other, whatever they are read with; those without repeats leave the arrays.
    """
    rules, left = np.zeros(n_owners, dtype=np.int64), np.zeros(n_owners, dtype=np.int64)
    a, f = symbols, owner
    while len(a):
        pair = _mix(a[:-1], a[1:])
        same = f[:-1] == f[1:]
        # of overlapping equal pairs every other one counts
        place = np.arange(len(pair))
        again = np.concatenate((np.zeros(min(1, len(pair)), dtype=bool), (pair[1:] == pair[:-1]) & same[1:] & same[:-1]))
        same &= (place - np.maximum.accumulate(np.where(again, 0, place))) % 2 == 0
        # equal pairs of a file are equal here: 24 bits of the file, 39 of the pair
        code = np.where(same, (f[:-1] << 39) | (pair >> 24), -1)
        order = np.argsort(code)
        ranked = code[order]
        heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(ranked)), dtype=bool), ranked[1:] != ranked[:-1])))
        counts = np.diff(np.concatenate((heads, [len(ranked)])))
        count = np.empty(len(code), dtype=np.int32)
        count[order] = np.repeat(counts, counts)
        count[~same | (count < 2)] = 0
        before_c, after_c = np.concatenate(([0], count[:-1])), np.concatenate((count[1:], [0]))
        before_h, after_h = np.concatenate(([-1], pair[:-1])), np.concatenate((pair[1:], [-1]))
        at = np.flatnonzero((count > 0) & ((count > before_c) | (count == before_c) & (pair > before_h)) & ((count > after_c) | (count == after_c) & (pair >= after_h)))
        _, first, inverse, times = np.unique(code[at], return_index=True, return_inverse=True, return_counts=True)
        rules += np.bincount(f[at[first[times > 1]]], minlength=n_owners)
        at = at[times[inverse] > 1]
        # a file in which nothing was replaced is done
        busy = np.zeros(n_owners, dtype=bool)
        busy[f[at]] = True
        a = a.copy()
        a[at] = pair[at]
        keep = np.ones(len(a), dtype=bool)
        keep[at + 1] = False
        left += np.bincount(f[keep & ~busy[f]], minlength=n_owners)
        keep &= busy[f]
        a, f = a[keep], f[keep]
    return left, rules


def content_rules(symbols: np.ndarray, owner: np.ndarray, rounds: int = SHARED_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rule, owner, tokens under it): the sequences after rounds in which a pair becomes a rule where its hash is least among neighbours."""
    a, f, n = symbols, owner, np.ones(len(symbols), dtype=np.int64)
    top = np.int64(_MASK)
    for _ in range(rounds):
        if len(a) < 3:
            break
        same = f[:-1] == f[1:]
        pair = _mix(a[:-1], a[1:])
        pair[~same] = top
        before, after = np.concatenate(([top], pair[:-1])), np.concatenate((pair[1:], [top]))
        at = np.flatnonzero((pair < top) & (pair < before) & (pair <= after))
        at = at[np.concatenate(([True], np.diff(at) > 1))] if len(at) else at
        if not len(at):
            break
        a, n = a.copy(), n.copy()
        a[at] = pair[at]
        n[at] += n[at + 1]
        keep = np.ones(len(a), dtype=bool)
        keep[at + 1] = False
        a, f, n = a[keep], f[keep], n[keep]
    return a, f, n


def _sequences(exts: list, bodies: list):
    """Arrays over all lexemes of a batch: kind, size, shape, raw hash, file."""
    for lex in _LEXICONS.values():
        if len(lex) > lex.LIMIT:  # never within a batch, whose rows point into it
            lex.reset()
    parts, owners = [], []
    for i, (ext, body) in enumerate(zip(exts, bodies)):
        if body:
            at, lex = _read(ext or "", body)
            parts.append((at, lex))
            owners.append(np.full(len(at), i, dtype=np.int64))
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z
    lexicons = {id(lex): lex for _, lex in parts}
    by_lex = {i: tuple(np.array(x, dtype=np.int64) for x in (lex.kinds, lex.sizes, lex.shapes, lex.raws)) for i, lex in lexicons.items()}
    columns = [np.concatenate([by_lex[id(lex)][k][at] for at, lex in parts]) for k in range(4)]
    return (*columns, np.concatenate(owners))


def _features(exts: list, bodies: list, shared: np.ndarray) -> dict[str, np.ndarray]:
    m = len(bodies)
    kind, size, shape, raw, file = _sequences(exts, bodies)
    per = lambda mask, w=None: np.bincount(file[mask], weights=None if w is None else w[mask], minlength=m)
    code = (kind != SKIP) & (kind != LINE)
    n, lines = per(code), per(kind == LINE) + 1
    chars = np.array([len(b) if b else 0 for b in bodies], dtype=np.float64)
    dark = per(kind != LINE, size)
    names = per(kind == NAME)
    with np.errstate(divide="ignore", invalid="ignore"):
        white = np.where(chars > 0, 1 - dark / chars, 0.0)
        name_size = np.where(names > 0, per(kind == NAME, size) / names, 99.0)
    # grammar over all tokens
    left, rules = grammar_sizes(shape[code], file[code], m)
    reuse = np.where(n > 0, (left + 2 * rules) / np.maximum(n, 1), 1.0)
    # runs of literals
    k, s, f, r = kind[code], size[code], file[code], raw[code]
    inside = (k == LITERAL) | (k == BETWEEN)
    starts = np.concatenate(([True], (inside[1:] != inside[:-1]) | (f[1:] != f[:-1]))) if len(k) else np.zeros(0, dtype=bool)
    run = np.cumsum(starts) - 1 if len(k) else np.zeros(0, dtype=np.int64)
    literal = k == LITERAL
    in_run = np.zeros(len(k), dtype=bool)
    if len(k):
        per_run = np.bincount(run, weights=literal, minlength=run[-1] + 1)
        chars_run = np.bincount(run, weights=literal * s, minlength=run[-1] + 1)
        in_run = inside & ((per_run[run] >= RUN) | (chars_run[run] >= LONG_LITERAL))
    data = np.bincount(f[in_run], weights=s[in_run], minlength=m) / np.maximum(np.bincount(f, weights=s, minlength=m), 1)
    mask = in_run & literal
    lit_n = np.bincount(f[mask], minlength=m)
    lit_left, lit_rules = grammar_sizes(r[mask], f[mask], m) if mask.any() else (np.zeros(m), np.zeros(m))
    literals = np.where(lit_n > 0, (lit_left + 2 * lit_rules) / np.maximum(lit_n, 1), 0.0)
    # rules shared with the library files
    rule, owner, tokens = content_rules(shape[code], f)
    known = np.isin(rule, shared)
    copied = np.bincount(owner[known], weights=tokens[known], minlength=m) / np.maximum(n, 1)
    return {"n_tokens": n.astype(np.int64), "reuse": reuse, "white": white, "name_size": name_size, "per_line": n / lines, "data_share": data, "literal_ratio": literals, "copied_share": copied}


#: Characters of the files that are read at once, which bounds a worker's memory.
PART_CHARS = 4_000_000


def _parts(batch: pa.RecordBatch, body: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most PART_CHARS characters, or of one file."""
    begin, chars = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(batch.column(body)), 0).to_pylist()):
        if chars and chars + n > PART_CHARS:
            yield batch.slice(begin, i - begin)
            begin, chars = i, 0
        chars += n
    if batch.num_rows > begin:
        yield batch.slice(begin)


FEATURES = "n_tokens bigint, reuse double, white double, name_size double, per_line double, data_share double, literal_ratio double, copied_share double"


def _rows_of() -> list[Column]:
    return [F.col("file_id").cast("bigint").alias("file_id"), extension(F.col("rel_path")).alias("ext"), F.col("body").cast("string").alias("body")]


def file_rules(files: DataFrame, *kept: str) -> DataFrame:
    """(file_id, kept..., rule, n_tokens): every file's sequence of content rules, with the tokens under each; ``kept`` are string columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _parts(whole, 2)):
            kind, _, shape, _, file = _sequences(b.column(1).to_pylist(), b.column(2).to_pylist())
            code = (kind != SKIP) & (kind != LINE)
            rule, owner, n = content_rules(shape[code], file[code])
            ids = b.column(0).to_numpy(zero_copy_only=False)
            more = [b.column(3 + i).take(pa.array(owner)) for i in range(len(kept))]
            yield pa.record_batch([pa.array(ids[owner], pa.int64()), *more, pa.array(rule), pa.array(n)], names=["file_id", *kept, "rule", "n_tokens"])

    rows = files.select(*_rows_of(), *[F.col(c).cast("string").alias(c) for c in kept])
    return rows.mapInArrow(run, "file_id bigint, " + "".join(f"{c} string, " for c in kept) + "rule bigint, n_tokens bigint")


def library_rules(upstream: DataFrame) -> DataFrame:
    """(rule): the distinct content rules of the library files (lang or rel_path, body) that span several tokens."""
    return file_rules(upstream.select(F.lit(0).alias("file_id"), "rel_path", "body")).where("n_tokens >= 4").select("rule").distinct()


def head_comments(body: str | None, ext: str | None = None) -> str:
    """What a file says of itself: all comments and the docstring before its first code."""
    if not body:
        return ""
    body = body.replace("\r\n", "\n").replace("\r", "\n")
    # without a docstring's quotes, so that its only line isn't taken for a mention
    return _DOCSTRING.sub(r"\2", body[: _LEADING[ext not in DIRECTIVES].match(body).end()])


def file_features(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, rel_path, head, ``FEATURES``) of every file of ``files`` (file_id, rel_path, body).

    Null and empty bodies have no tokens, reuse 1 and shares 0.
    """
    rules = library_rules(upstream)
    first = [r[0] for r in rules.limit(MAX_SHARED_RULES + 1).collect()]
    few = len(first) <= MAX_SHARED_RULES
    shared = files.sparkSession.sparkContext.broadcast(np.array(first if few else [], dtype=np.int64))
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in _parts(whole, 2)):
            exts, bodies = b.column(1).to_pylist(), b.column(2).to_pylist()
            x = _features(exts, bodies, shared.value)
            heads = pa.array([head_comments(body, ext) for ext, body in zip(exts, bodies)], pa.string())
            yield pa.record_batch([b.column(0), b.column(3), heads, *[pa.array(x[c]) for c in names]], names=["file_id", "rel_path", "head", *names])

    rows = files.select(*_rows_of(), "rel_path")
    out = rows.mapInArrow(run, f"file_id bigint, rel_path string, head string, {FEATURES}")
    if few:
        return out
    known = file_rules(files).join(rules, "rule", "left_semi").groupBy("file_id").agg(F.sum("n_tokens").alias("known"))
    return out.join(known, "file_id", "left").withColumn("copied_share", F.coalesce(F.col("known") / F.col("n_tokens"), F.lit(0.0))).drop("known")


def _signed(head: Column) -> Column:
    """Whether ``head_comments`` sign a file as a tool's output."""
    bare = F.regexp_replace(F.regexp_replace(head, r"<auto-?generated[^\n]*", "<auto-generated"), r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`|“[^”\n]*”", "")
    return bare.rlike("(?i)" + SIGNATURES)


def third_party_dir(path: Column) -> Column:
    """Whether a path leads through a directory for copies of third parties."""
    one = r"(^|/)(" + "|".join(d.replace("-", r"\-") for d in VENDOR_DIRS) + ")/"
    two = r"(^|/)(" + "|".join(VENDOR_PARENTS) + ")/[^/]+/"
    return path.rlike(one) | path.rlike(two)


def classified_files(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, generated, minified, vendored, blob, and the features): one row per file of ``files``.

    files: file_id, rel_path, body; upstream: rel_path, body.  A null body or path has no sign of its own;
    ties don't arise, every file is judged by itself.
    """
    x = file_features(files, upstream)
    enough = F.col("n_tokens") >= MIN_TOKENS
    path = F.coalesce(F.col("rel_path"), F.lit(""))
    return x.select(
        "file_id",
        (enough & (F.col("reuse") < REUSE) | _signed(F.coalesce(F.col("head"), F.lit(""))) | path.rlike(TOOL_NAMES)).alias("generated"),
        ((F.col("n_tokens") >= 20) & (F.col("white") < MIN_WHITE) & ((F.col("name_size") < MIN_NAME) | (F.col("per_line") > MIN_PER_LINE)) & (F.col("data_share") < BLOB)).alias("minified"),
        (third_party_dir(path) | (enough & (F.col("copied_share") >= COPIED))).alias("vendored"),
        ((F.col("data_share") >= BLOB) & (F.col("literal_ratio") >= INCOMPRESSIBLE)).alias("blob"),
        *[c.split()[0] for c in FEATURES.split(", ")],
    )


def not_handwritten(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """The rows of ``classified_files`` with any of the four marks."""
    return classified_files(files, upstream).where("generated or minified or vendored or blob")


def shared_rules(files: DataFrame) -> DataFrame:
    """(file_id, repo, n_tokens, shared_share, vendored): per file the share of its tokens under rules that another repo has too.

    Files without tokens are left out; a null repo is a repo of its own, repeated file_ids count together.
    vendored: ``MIN_TOKENS`` and a share of ``COPIED`` at least, so that the file, or most of it, is kept in
    several repos.  Rules are counted per repo before repos meet, so a rule that a repo repeats is one row.
    """
    # read and lexed once, for three uses
    owned = written(file_rules(files, "repo"))
    long = owned.where(F.col("n_tokens") >= SHARED_SPAN)
    repo = F.coalesce("repo", F.lit(""))
    several = long.groupBy("rule").agg((F.min(repo) != F.max(repo)).alias("several")).where("several").select("rule")
    shared = long.join(several, "rule", "left_semi").groupBy("file_id", "repo").agg(F.sum("n_tokens").alias("shared")).select(F.col("file_id").alias("_f"), F.col("repo").alias("_r"), "shared")
    total = owned.groupBy("file_id", "repo").agg(F.sum("n_tokens").alias("n_tokens"))
    known = total.join(shared, (F.col("file_id") == F.col("_f")) & F.col("repo").eqNullSafe(F.col("_r")), "left")
    share = F.coalesce(F.col("shared"), F.lit(0)) / F.col("n_tokens")
    return known.select("file_id", "repo", "n_tokens", share.alias("shared_share"), ((F.col("n_tokens") >= MIN_TOKENS) & (share >= COPIED)).alias("vendored"))
