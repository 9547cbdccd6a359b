"""The report: its numbers as DataFrames, its text on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analyze import confidence_mix, cross_file_surprises, described_nodes, god_nodes, knowledge_gaps, suggested_questions
from ..functions.text import community_name, thousands
from .cluster import cohesion, stored_communities
from .graph import Graph, token_totals
from .incremental import VersionedTable

#: Members that a community needs to be listed, and labels that are shown of it.
MIN_SIZE, SHOWN = 3, 8


def community_sections(g: Graph, min_size: int = MIN_SIZE, shown: int = SHOWN) -> DataFrame:
    """(cid, n_members, labels, n_more, cohesion) of communities with at least min_size members that aren't files, the largest first.

    Only the first labels of a community are gathered, never all of its members.
    """
    d = described_nodes(g).where("community is not null and not is_file")
    rank = F.row_number().over(Window.partitionBy("community").orderBy("ord"))
    top = d.select("community", F.coalesce("label", "id").alias("label"), rank.alias("rn")).where(F.col("rn") <= shown)
    listed = top.groupBy(F.col("community").alias("cid")).agg(F.array_sort(F.collect_list(F.struct("rn", "label"))).alias("x"))
    sizes = d.groupBy(F.col("community").alias("cid")).agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") >= min_size)
    rows = listed.join(sizes, "cid").select("cid", "n_members", F.transform("x", lambda s: s["label"]).alias("labels"), F.greatest(F.col("n_members") - shown, F.lit(0)).alias("n_more"))
    return rows.join(cohesion(g, stored_communities(g)).select("cid", "cohesion"), "cid")


def ambiguous_edges(g: Graph) -> DataFrame:
    """(src, tgt, relation) of ambiguous edges."""
    return g.edges.where("confidence = 'AMBIGUOUS'").select("src", "tgt", F.coalesce("relation", F.lit("unknown")).alias("relation"))


def thin_communities(g: Graph, min_size: int = MIN_SIZE) -> DataFrame:
    """(cid, n_members) of communities with some, but fewer than min_size members that aren't files."""
    d = described_nodes(g).where("community is not null and not is_file")
    return d.groupBy(F.col("community").alias("cid")).agg(F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") < min_size)


def navigation(g: Graph) -> DataFrame:
    """(cid, name, heading) of communities with a member that isn't a file: links of a report to their pages."""
    d = described_nodes(g).where("community is not null and not is_file").select(F.col("community").alias("cid")).distinct()
    name = F.concat(F.lit("Community "), F.col("cid").cast("string"))
    return d.select("cid", name.alias("name"), community_name(name).alias("heading"))


def corpus_lines(detection: DataFrame) -> list[str]:
    """The corpus check of a ``detection_summary``: a warning in place of the counts if there is one."""
    d = detection.select("total_files", thousands(F.col("total_words")).alias("words"), "large", "needs_graph").first()
    if not d.needs_graph:
        return ["- no files found"]
    if d.large:
        return [f"- about {d.words} words: extraction of a corpus this large is costly"]
    return [f"- {d.total_files} files, about {d.words} words"]


def cost_totals(ledger: DataFrame) -> DataFrame:
    """One row: n_runs, input_tokens, output_tokens of a ledger (run_at, input_tokens, output_tokens), missing ones as 0."""
    return token_totals(ledger).crossJoin(ledger.agg(F.count(F.lit(1)).alias("n_runs"))).select("n_runs", "input_tokens", "output_tokens")


def add_cost(ledger: VersionedTable, run_at: str, input_tokens: int, output_tokens: int) -> int:
    """Adds a run to the ledger; its new version."""
    row = ledger.spark.createDataFrame([(run_at, input_tokens, output_tokens)], "run_at string, input_tokens bigint, output_tokens bigint")
    return ledger.commit(add=row)


def _listed(rows: DataFrame, shown: int, line) -> list[str]:
    """The first rows as lines, and how many more there are."""
    found = rows.limit(shown + 1).collect()
    more = rows.count() - shown if len(found) > shown else 0
    return [line(r) for r in found[:shown]] + ([f"- and {more:,} more"] if more > 0 else [])


def report_text(g: Graph, title: str = "Graph report", communities: int = 50, detection: DataFrame | None = None, tokens: tuple[int, int] = (0, 0), shown: int = 50) -> str:
    """Markdown of the report.  Lists end after ``shown`` lines and say how many more there are.

    detection: a ``detection_summary``, for the corpus check; tokens: what the extraction took in and gave out.
    """
    size, mix = g.size().first(), confidence_mix(g).first()
    pages = navigation(g)
    out = [f"# {title}"] + (["", "## Corpus check", "", *corpus_lines(detection)] if detection is not None else [])
    out += ["", "## Summary", "", f"- {size.n_nodes:,} nodes, {size.n_edges:,} edges, {pages.count():,} communities", f"- tokens: {tokens[0]:,} in, {tokens[1]:,} out", "", "## Confidence", ""]
    out += [f"- {c}: {mix['n_' + c.lower()]:,} ({mix['pct_' + c.lower()]} %)" for c in ("EXTRACTED", "INFERRED", "AMBIGUOUS")]
    if mix.n_inferred:
        out.append(f"- mean score of inferred edges {mix.inferred_mean}")
    out += ["", "## Community pages", ""] + _listed(pages.orderBy("cid"), shown, lambda r: f"- [[{r.heading}|{r.name}]]")
    out += ["", "## Hubs", ""] + [f"- {r.label} ({r.degree})" for r in god_nodes(g).collect()]
    out += ["", "## Surprising connections", ""] + [f"- {r.source_label} - {r.target_label}: {r.why} [{r.confidence}]" for r in cross_file_surprises(g).collect()]
    out += ["", "## Communities", ""]
    out += _listed(community_sections(g).orderBy(F.desc("n_members"), "cid"), communities, lambda r: f"- {r.cid} ({r.n_members}, cohesion {r.cohesion}): {', '.join(r.labels)}" + (f" (+{r.n_more} more)" if r.n_more else ""))
    if g.hyperedges is not None:
        out += ["", "## Groups", ""] + _listed(g.hyperedges.orderBy("id"), shown, lambda r: f"- {r.label}: {', '.join(r.nodes)} [{r.confidence or 'INFERRED'}]")
    out += ["", "## Ambiguous edges", ""] + _listed(ambiguous_edges(g).orderBy("src", "tgt"), shown, lambda r: f"- {r.src} {r.relation} {r.tgt}")
    gaps = knowledge_gaps(g)
    out += ["", "## Gaps", ""] + [f"- {r.label}" for r in gaps.orderBy("ord").limit(5).collect()] + [f"- {gaps.count():,} nodes with at most one connection, {thin_communities(g).count():,} thin communities"]
    if mix.pct_ambiguous > 20:
        out.append("- more than a fifth of the edges is ambiguous")
    out += ["", "## Questions", ""] + [f"- {r.question} ({r.why})" for r in suggested_questions(g).collect()]
    return "\n".join(out) + "\n"
