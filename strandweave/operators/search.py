"""Keyword search, subgraph text, explanations and the token benchmark."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import BENCHMARK_QUESTIONS, CONTEXT_WORDS
from ..functions.text import render_label, strip_call
from ..sources.session import bounded
from .graph import Graph
from .traverse import bfs_edges, bfs_levels, dfs_order

#: Questions that meet all nodes in one pass.
MAX_QUESTIONS = 10_000


@F.pandas_udf(T.StringType())
def _without_marks(s: pd.Series) -> pd.Series:
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.category(c).startswith("M")).lower()
    return s.map(fold, na_action="ignore")


def norm_label(label: Column) -> Column:
    """Lower case without accents, compatibility forms written out.  Plain ASCII stays in the JVM's columns; the rest needs Unicode tables."""
    return _without_marks(label)


def with_norm_label(nodes: DataFrame) -> DataFrame:
    """Nodes with norm_label; only rows with other than ASCII characters go through Python."""
    plain = F.coalesce(F.col("label").rlike(r"^\p{ASCII}*$"), F.lit(True))
    return nodes.where(plain).withColumn("norm_label", F.lower("label")).unionByName(nodes.where(~plain).withColumn("norm_label", norm_label(F.col("label"))))


def query_terms(question: str, min_bytes: int = 3) -> list[str]:
    """Words of at least min_bytes bytes, in lower case and without accents, punctuation kept."""
    return [_plain(w) for w in question.split() if len(w.encode()) >= min_bytes]


def _plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.category(c).startswith("M")).lower()


def inferred_contexts(question: str) -> list[str]:
    words = {_plain(w) for w in question.replace("?", " ").replace(",", " ").split()}
    return [c for c, keys in CONTEXT_WORDS.items() if words & set(keys)]


def resolved_contexts(question: str, explicit: list[str] | None = None) -> list[str]:
    """Explicit contexts, normalised and once each, else those a question asks for."""
    given = list(dict.fromkeys(re.sub(r"[\s-]+", "_", c.strip().lower()) for c in explicit or [] if c.strip()))
    return given or inferred_contexts(question)


def score_nodes(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(q_id, id, score, ord) of nodes that match questions (q_id, terms array<string>), score above 0.

    Per term 1 if the label contains it and 0.5 if the source file does; 100 once if a term is the
    label, without trailing '()' or as it is.  Repeated terms count each.  The questions are few: each
    node meets all of them in one pass.
    """
    n = with_norm_label(nodes).select("id", "ord", F.coalesce("norm_label", F.lit("")).alias("l"), F.lower(F.coalesce("source_file", F.lit(""))).alias("f"))
    q = bounded(questions.select("q_id", "terms"), MAX_QUESTIONS, "questions at once")
    hits = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.when(F.contains(F.col("l"), t), 1.0).otherwise(0.0) + F.when(F.contains(F.col("f"), t), 0.5).otherwise(0.0))
    whole = F.exists("terms", lambda t: (t == F.col("l")) | (t == strip_call(F.col("l"))))
    scored = n.crossJoin(q).select("q_id", "id", "ord", (hits + F.when(whole, 100.0).otherwise(0.0)).alias("score"))
    return scored.where("score > 0").select("q_id", "id", "score", "ord")


def query_seeds(nodes: DataFrame, questions: DataFrame, n: int = 3) -> DataFrame:
    """The n best nodes of every question; ties by ord."""
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "ord")
    return score_nodes(nodes, questions).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("q_id", F.col("place").cast("bigint").alias("place"), "id", "score")


def find_nodes(nodes: DataFrame, term: str) -> DataFrame:
    """(ord, id, label) of nodes whose folded label contains the folded term, or whose lower-case id is the term; in order of ord."""
    t = _plain(term)
    hit = F.contains(F.coalesce("norm_label", F.lit("")), F.lit(t)) | (F.lower("id") == t)
    return with_norm_label(nodes).where(hit).select("ord", "id", "label").orderBy("ord")


def node_details(g: Graph, term: str) -> DataFrame:
    """The node that a term means, at most one row (id, label, file_type, source_file, source_location, community, degree).

    Its lower-case label contains the term or the term contains it, or its lower-case id is the term; a
    node without a label is in every term.  The first by ord counts.
    """
    t = F.lit(term.lower())
    label = F.lower(F.coalesce("label", F.lit("")))
    first = g.nodes.where(F.contains(label, t) | F.contains(t, label) | (F.lower("id") == t)).orderBy("ord").limit(1)
    degree = g.neighbors(first.select("id")).agg(F.count(F.lit(1)).alias("degree"))
    # one row each
    return first.select("id", F.coalesce("label", "id").alias("label"), "file_type", "source_file", "source_location", "community").crossJoin(degree)


def subgraph_lines(g: Graph, levels: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(q_id, kind, a, b, c, line): the subgraph as lines; ordered by kind, a, b, c, line: seeds, other nodes by degree, then edges."""
    d = levels.join(g.nodes.join(g.degrees(), "id"), "id").join(seeds.select("q_id", "id", F.col("place").alias("_seed")), ["q_id", "id"], "left")
    none = F.lit("")
    show = lambda c: render_label(F.coalesce(F.col(c).cast("string"), none))
    node = F.concat(F.lit("NODE "), render_label(F.coalesce("label", "id")), F.lit(" [src="), show("source_file"), F.lit(" loc="), show("source_location"), F.lit(" community="), show("community"), F.lit("]"))
    first = d.select("q_id", F.lit(0).alias("kind"), F.coalesce("_seed", F.lit(1 << 40)).alias("a"), (-F.col("degree")).alias("b"), F.col("ord").alias("c"), node.alias("line"))
    names = g.nodes.select("id", render_label(F.coalesce("label", "id")).alias("name"))
    e = edges.select("q_id", F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct().join(g.edges.select("src", "tgt", "relation", "confidence", F.col("ord").alias("c")), ["src", "tgt"])
    e = e.join(names.withColumnsRenamed({"id": "src", "name": "na"}), "src").join(names.withColumnsRenamed({"id": "tgt", "name": "nb"}), "tgt")
    line = F.concat(F.lit("EDGE "), "na", F.lit(" --"), F.coalesce("relation", none), F.lit(" ["), F.coalesce("confidence", none), F.lit("]--> "), "nb")
    second = e.select("q_id", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "c", line.alias("line"))
    return first.unionByName(second)


def render_lines(g: Graph, levels: DataFrame, edges: DataFrame, seeds: DataFrame, budget: int = 2000, bytes_per_token: int = 3) -> DataFrame:
    """(q_id, place, line): the ``subgraph_lines`` in order, as many as ``budget`` * ``bytes_per_token`` bytes hold.

    Lines are cut whole.  A line takes two bytes at least, so only so many of a question can be kept:
    these are picked in every partition before the rest meet in order.
    """
    most = budget * bytes_per_token
    w = Window.partitionBy("q_id").orderBy("kind", "a", "b", "c", "line")
    near = subgraph_lines(g, levels, edges, seeds).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most // 2 + 1)
    used = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("q_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("used", used).where(F.col("used") <= most).select("q_id", F.col("place").cast("bigint").alias("place"), "line")


def query_text(g: Graph, question: str, mode: str = "bfs", depth: int | None = None, budget: int = 2000, contexts: list[str] | None = None, min_chars: int | None = None, bytes_per_token: int = 3) -> str:
    """The answer's subgraph as text, for the command line and the tool server.

    depth: 3 if it isn't given.  min_chars: least length of a term in characters instead of three bytes;
    bytes_per_token: what the budget counts as a token.
    """
    spark, depth = g.nodes.sparkSession, 3 if depth is None else depth
    words = query_terms(question) if min_chars is None else [t for w in question.split() if len(w) >= min_chars for t in query_terms(w, 1)]
    q = spark.createDataFrame([(0, words)], "q_id bigint, terms array<string>")
    seeds = query_seeds(g.nodes, q)
    found = seeds.orderBy("place").collect()
    if not found:
        return "No matching nodes found."
    wanted = resolved_contexts(question, contexts)
    starts = spark.createDataFrame([(0, r.id) for r in found], "q_id bigint, id string")
    seeds = spark.createDataFrame([(0, r.id, r.place) for r in found], "q_id bigint, id string, place bigint")
    levels = bfs_levels(g, starts, depth, wanted) if mode == "bfs" else dfs_order(g, starts, depth, wanted).select("q_id", "id", "depth")
    crossed = bfs_edges(g, levels, wanted)
    # the budget bounds what comes to the driver
    kept = [r.line for r in render_lines(g, levels, crossed, seeds, budget, bytes_per_token).orderBy("place").collect()]
    n = subgraph_lines(g, levels, crossed, seeds).agg(F.count_if(F.col("line").startswith("NODE ")).alias("n"), F.count(F.lit(1)).alias("all")).first()
    head = f"Traversal: {mode} | Start: {', '.join(r.id for r in found)}" + (f" | Context: {', '.join(wanted)}" if wanted else "") + f" | {n['n']} nodes found"
    return "\n".join([head, *kept]) + ("\n... cut at the token budget" if len(kept) < n["all"] else "")


def explain_neighbors(g: Graph, ids: DataFrame, top: int = 20) -> DataFrame:
    """(id, place, neighbor, relation, degree, n_neighbors): the top neighbours of every id by their degree, ties by neighbour id.

    Neighbours are counted by aggregation and ranked by a window of nothing else, so that a hub's are
    cut to the top in every partition before they meet.
    """
    near = g.neighbors(ids).select(F.col("src").alias("id"), F.col("tgt").alias("neighbor"), F.coalesce("relation", F.lit("")).alias("relation"))
    d = near.join(g.degrees().withColumnRenamed("id", "neighbor"), "neighbor")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("degree"), "neighbor"))
    best = d.withColumn("place", place).where(F.col("place") <= top)
    counts = near.groupBy("id").agg(F.count(F.lit(1)).alias("n_neighbors"))
    return best.join(counts, "id").select("id", F.col("place").cast("bigint").alias("place"), "neighbor", "relation", "degree", "n_neighbors")


def explanation(g: Graph, term: str, top: int = 20) -> str:
    """A node's details and its first neighbours, for the command line."""
    found = find_nodes(g.nodes, term).limit(1).collect()
    if not found:
        return f"no node matches '{term}'"
    node = g.nodes.where(F.col("id") == found[0].id)
    row = node.select("id", F.coalesce("label", "id").alias("label"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("file_type", "source_file", "source_location", "community")]).first()
    near = explain_neighbors(g, node.select("id"), top)
    named = near.join(g.nodes.select(F.col("id").alias("neighbor"), F.coalesce("label", "id").alias("label")), "neighbor").join(g.neighbors(node.select("id")).select(F.col("tgt").alias("neighbor"), F.coalesce("confidence", F.lit("")).alias("confidence")), "neighbor")
    rows = named.orderBy("place").collect()
    n = rows[0].n_neighbors if rows else 0
    out = [f"Node: {row.label}", f"  Id: {row.id}", f"  Source: {row.source_file} {row.source_location}", f"  Type: {row.file_type}", f"  Community: {row.community}", f"  Degree: {n}"]
    out += [f"  -> {r.label} [{r.relation}] [{r.confidence}]" for r in rows] + ([f"  ... and {n - top} more"] if n > top else [])
    return "\n".join(out)


def benchmark_seeds(nodes: DataFrame, questions: DataFrame, n: int = 3) -> DataFrame:
    """(q_id, id, place) of the n nodes whose lower-case label contains most of a question's terms; ties by ord."""
    q = bounded(questions.select("q_id", "terms"), MAX_QUESTIONS, "questions at once")
    label = nodes.select("id", "ord", F.lower(F.coalesce("label", F.lit(""))).alias("l"))
    hits = F.size(F.filter("terms", lambda t: F.contains(F.col("l"), t)))
    scored = label.crossJoin(q).select("q_id", "id", "ord", hits.alias("hits")).where("hits > 0")
    place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("hits"), "ord"))
    return scored.withColumn("place", place).where(F.col("place") <= n).select("q_id", "id", "place")


def query_subgraph_tokens(g: Graph, questions: DataFrame, depth: int = 3) -> DataFrame:
    """(q_id, tokens) of the plain text of each question's subgraph; questions (q_id, terms) without a seed are left out.

    The text has a line for every node within ``depth`` of the seeds and for every edge between one level
    and the next; its bytes are summed, it isn't put together.
    """
    levels = bfs_levels(g, benchmark_seeds(g.nodes, questions), depth)
    none = F.lit("")
    names = g.nodes.select("id", F.coalesce("label", "id").alias("name"), F.coalesce("source_file", none).alias("f"), F.coalesce("source_location", none).alias("at"))
    nodes = levels.join(names, "id").select("q_id", F.concat(F.lit("NODE "), "name", F.lit(" src="), "f", F.lit(" loc="), "at").alias("line"))
    crossed = bfs_edges(g, levels).join(g.edges.select(F.col("src").alias("low"), F.col("tgt").alias("high"), F.coalesce("relation", none).alias("relation")), (F.least("src", "tgt") == F.col("low")) & (F.greatest("src", "tgt") == F.col("high")))
    named = lambda end, name: names.select(F.col("id").alias(end), F.col("name").alias(name))
    lines = crossed.join(named("src", "na"), "src").join(named("tgt", "nb"), "tgt").select("q_id", F.concat(F.lit("EDGE "), "na", F.lit(" --"), "relation", F.lit("--> "), "nb").alias("line"))
    both = nodes.unionByName(lines).groupBy("q_id").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    return both.select("q_id", F.greatest(F.floor((F.col("bytes") - 1) / 4), F.lit(1)).cast("bigint").alias("tokens"))


def run_benchmark(g: Graph, questions: tuple[str, ...] = BENCHMARK_QUESTIONS, corpus_words: int | None = None) -> DataFrame:
    """One row: corpus_tokens, questions answered, their average tokens and the reduction ratio to one decimal (null without any)."""
    spark = g.nodes.sparkSession
    terms = lambda t: [w.lower() for w in t.split() if len(w.encode()) > 2]
    q = spark.createDataFrame([(i, terms(t)) for i, t in enumerate(questions)], "q_id bigint, terms array<string>")
    tokens = query_subgraph_tokens(g, q)
    words = F.col("n_nodes") * 50 if corpus_words is None else F.lit(corpus_words)
    out = tokens.agg(F.count(F.lit(1)).alias("n_questions"), F.floor(F.avg("tokens")).cast("bigint").alias("avg_tokens")).crossJoin(g.nodes.agg(F.count(F.lit(1)).alias("n_nodes")))
    corpus = F.floor(words * 100 / 75).cast("bigint")
    return out.select(corpus.alias("corpus_tokens"), "n_questions", "avg_tokens", (F.floor(corpus / F.col("avg_tokens") * 10 + 0.5) / 10).alias("ratio"))


def benchmark_text(result: DataFrame) -> str:
    """``run_benchmark``'s row as lines; says so if no question met a node."""
    r = result.first()
    if r is None or not r.n_questions:
        return "no question met a node"
    return f"corpus: about {r.corpus_tokens:,} tokens\nanswer: {r.avg_tokens:,} tokens on average of {r.n_questions} questions\nreduction: {r.ratio}x"
