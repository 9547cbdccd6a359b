"""Queries over whole tables: what a cut of rows, lines, sizes or sweeps would lose."""

import unicodedata

from strandweave.operators import search
from strandweave.plans import queries
from test_graph import E, N

LABELS = ["catalog", "Catálogo()", "ﬁlter MODULE", "Главный catalog", "カタログ schema", "ｓｃｈｅｍａ", "İmport schéma", "main()", "máin()", "Ångström", None]


def _folded(label):
    return "".join(c for c in unicodedata.normalize("NFKD", label) if not unicodedata.category(c).startswith("M")).lower()


def _tables(spark, folder):
    nodes = [(i, f"n{i}", label, "code", "src/schema.py" if i % 4 == 0 else "src/x.py", None, None, "r") for i, label in enumerate(LABELS)]
    spark.createDataFrame(nodes, N).write.parquet(f"{folder}/nodes.parquet")
    spark.createDataFrame([(0, "n0", "n1", "calls", None, None, None, None, None, None)], E).write.parquet(f"{folder}/edges.parquet")
    return str(folder), nodes


def test_labels_beyond_ascii_are_folded_and_scored(spark, rows, tmp_path):
    d, nodes = _tables(spark, tmp_path)
    assert rows(queries.norm_labels(spark, d)) == sorted([(n[1], None if n[2] is None else _folded(n[2])) for n in nodes], key=repr)
    want = []
    for q, asked in queries._ASKED:
        for i, x, label, _, file, *_ in nodes:
            text, terms = _folded(label or ""), search.query_terms(asked)
            score = sum((t in text) + 0.5 * (t in file) for t in terms) + 100.0 * any(t in (text, text.removesuffix("()")) for t in terms)
            if score:
                want.append((q, x, score, i))
    assert {"n1", "n2", "n4", "n5", "n8"} <= {w[1] for w in want}
    assert rows(queries.score_nodes(spark, d)) == sorted(want, key=repr)
    seeds = []
    for q, _ in queries._ASKED:
        best = sorted((w for w in want if w[0] == q), key=lambda w: (-w[2], w[3]))[:3]
        seeds += [(q, k, w[1], w[2]) for k, w in enumerate(best, 1)]
    assert rows(queries.query_seeds(spark, d)) == sorted(seeds, key=repr)


def test_addresses_beyond_ascii_get_names(spark, rows, tmp_path):
    urls = ["https://x.org/a?b=c", "https://пример.рф/straße/é", "https://例え.jp/データ--1", "https://x.org/café/" + "ж" * 90]
    texts = [(i, f"---\nsource_url: {u}\n---\nbody") for i, u in enumerate(urls)] + [(9, "no front matter")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    word = lambda c: c in "_-" or unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc")

    def name(u):
        return "_".join(p for p in "".join(c if word(c) else "_" for c in u).split("_") if p)[:80]

    assert rows(queries.safe_filenames(spark, str(tmp_path))) == [(i, name(u)) for i, u in enumerate(urls)]
