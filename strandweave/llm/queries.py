"""Queries of the training-text operators; ``ORACLES`` has SQL where it can express them."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.session import checkpoint
from ..sources.tables import table
from . import lookalike, packing, provenance, repetition, syntax, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparseable(table(spark, d, "source_files")).select("file_id")


def p1_failures(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparseable(table(spark, d, "source_files"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(table(spark, d, "source_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "source_files"), table(spark, d, "upstream_files")).select("file_id")


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return provenance.classified_files(table(spark, d, "source_files"), table(spark, d, "upstream_files"))


def p3_shared(spark: SparkSession, d: str) -> DataFrame:
    return provenance.shared_rules(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, d, "nodes"))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_labels(table(spark, d, "nodes"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = checkpoint(tokenizer.token_counts(table(spark, d, "documents")))
    return packing.pack_documents(sizes, table(spark, d, "context_windows"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_pack(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive_documents(table(spark, d, "documents")).select("doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition_shares(table(spark, d, "documents")).drop("x")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_failures, p1_rates, p3_found, p3_classes, p3_shared, p5_found, p5_canonical, p6_ids, p7_pack, p7_fill, p8_found, p8_shares)}


def _looks_sql() -> str:
    """SQL of what ``lookalike.looks`` and its collation take as equal: the same fixed tables, with canonical composition."""
    one, many = lookalike.character_map()
    text = lambda cs: "".join(cs).replace("'", "''")
    gone = r"[\p{Cf}\p{Cc}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{FFF0}-\x{FFF8}]"
    # kinds of space and visible formats are mapped before what is invisible goes
    x = f"regexp_replace(translate(label, '{text(one)}', '{text(one.values())}'), '{gone}', '', 'g')"
    for c, to in many.items():
        if unicodedata.category(c).startswith("L"):
            x = f"replace({x}, '{c}', '{to}')"
    return f"nfc_normalize({x})"


def _shares_sql() -> str:
    """SQL of ``repetition.measure``: words, phrases of five of them (twelve in scripts without spaces), and units at three levels."""
    spaceless = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿຀-໿က-႟ក-៿ｦ-ﾟ\\x{20000}-\\x{3FFFF}"
    blank = "\\t\\n\\x0B\\f\\r \\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
    letters = "|".join(f"[^\\P{{{c}}}{spaceless}]" for c in ("L", "Nl", "No"))
    token = f"[{spaceless}]|(?:{letters})+|\\n[{blank}]*\\n|\\n|\\x01|[。！？｡]"
    window = "over (partition by r.doc_id order by i rows between {} preceding and current row)"
    lead = lambda k: ", ".join(f"lead(wd, {j}) over o" for j in range(1, k))
    unit = lambda n: f"sum(case when not isw and what >= {n} then 1 else 0 end) over (partition by doc_id order by p, q) u{n}"
    return f"""
with f as (select doc_id, lang, source, replace(replace(replace(lower(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))), 'ß', 'ss'), 'ς', 'σ'), chr(1), '_') x from documents),
t as (select doc_id, regexp_replace(regexp_replace(x, '[.!?…]+([{blank}"''”»)\\]])', chr(1) || '\\1', 'g'), '[.!?…]+$', chr(1)) x from f),
k as (select doc_id, unnest(l) tk, generate_subscripts(l, 1) p from (select doc_id, regexp_extract_all(x, '{token}') l from t)),
m as (select *, regexp_matches(tk[1], '[\\p{{L}}\\p{{N}}]') isw, case when tk[1] <> chr(10) then 0 when length(tk) = 1 then 1 else 2 end what from k),
s as (select doc_id, p, isw, what, unnest(l) tk, generate_subscripts(l, 1) q, len(l) > 1 spelt from (select *, case when isw and length(tk) > {repetition.LONGEST_WORD} then string_split(tk, '') else [tk] end l from m)),
n as (select *, sum(isw::int) over (partition by doc_id order by p, q) - 1 i, {unit(0)}, {unit(1)}, {unit(2)} from s),
w as (select doc_id, i, u0, u1, u2, case when spelt then chr(2) else '' end || tk wd, length(tk) sz, (spelt or regexp_matches(tk, '[{spaceless}]'))::int one from n where isw),
g as (select *, concat_ws(chr(3), wd, {lead(5)}) g5, lead(wd, 4) over o is not null has5, sum(one) over (partition by doc_id order by i rows between current row and 4 following) ones5,
    concat(wd, {lead(12)}) g12, lead(wd, 11) over o is not null has12, max(one) over (partition by doc_id) any1 from w window o as (partition by doc_id order by i)),
r as (select *, (has5 and ones5 = 0 and i > min(i) over (partition by doc_id, has5, g5))::int r5, (has12 and any1 = 1 and i > min(i) over (partition by doc_id, has12, g12))::int r12 from g),
un as (select doc_id, 0 lv, u0 u, string_agg(wd, '' order by i) key from w group by 1, 3 union all select doc_id, 1, u1, string_agg(wd, '' order by i) from w group by 1, 3 union all select doc_id, 2, u2, string_agg(wd, '' order by i) from w group by 1, 3),
ru as (select doc_id, lv, u from un qualify u > min(u) over (partition by doc_id, lv, key)),
z as (select r.doc_id, sz, max(r5) {window.format(4)} + max(r12) {window.format(11)} > 0 or a.u is not null or b.u is not null or c.u is not null again
    from r left join ru a on a.doc_id = r.doc_id and a.lv = 0 and a.u = u0 left join ru b on b.doc_id = r.doc_id and b.lv = 1 and b.u = u1 left join ru c on c.doc_id = r.doc_id and c.lv = 2 and c.u = u2),
sums as (select doc_id, sum(sz)::bigint n_letters, sum(case when again then sz else 0 end)::bigint n_repeated from z group by 1),
shares as (select f.doc_id, lang, source, coalesce(n_letters, 0) n_letters, coalesce(n_repeated, 0) n_repeated, coalesce(n_repeated / n_letters, 0.0) share from f left join sums on f.doc_id = sums.doc_id)
"""


_LOOKS = f"l as (select ord, repo, id, label, {_looks_sql()} looks from nodes where label is not null)"
ORACLES: dict[str, str] = {
    "p5_found": f"with {_LOOKS} select distinct a.id id_a, b.id id_b from l a join l b on a.repo = b.repo and a.looks = b.looks and a.id < b.id and a.label <> b.label",
    "p5_canonical": f"""
with {_LOOKS}, c as (select repo, looks, arg_min(label, struct_pack(odd := label <> looks, label := label)) canonical from l group by repo, looks)
select n.ord, n.repo, n.id, n.label, c.canonical from nodes n left join l on n.ord = l.ord left join c on l.repo is not distinct from c.repo and l.looks = c.looks
""",
    "p8_shares": _shares_sql() + "select * from shares",
    # the exact share, without the robust distance that chooses the candidates
    "p8_found": _shares_sql() + f"select doc_id from shares where share >= {repetition.LARGE}",
}
