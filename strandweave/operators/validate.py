"""Checks of extracted fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE_FIELDS = ("id", "label", "file_type", "source_file")
EDGE_FIELDS = ("source", "target", "relation", "confidence", "source_file")


def _problems(section: str, required: tuple[str, ...], present: Column | None, domain: str, allowed: tuple[str, ...]) -> Column:
    """Messages of one row, in the order of the rules; ``present`` is the array of its keys, or nulls count as missing."""
    missing = lambda f: ~F.array_contains(present, f) if present is not None else F.col(f).isNull()
    rules = [F.when(missing(f), F.struct(F.lit(i).alias("rule_no"), F.lit(f"{section}: missing field '{f}'").alias("message"))) for i, f in enumerate(required)]
    bad = F.col(domain).isNotNull() & ~F.col(domain).isin(*allowed)
    rules.append(F.when(bad, F.struct(F.lit(len(required)).alias("rule_no"), F.concat(F.lit(f"{section}: invalid {domain} '"), F.col(domain), F.lit("'")).alias("message"))))
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def validate_fragments(nodes: DataFrame, edges: DataFrame, keys: str | None = None) -> DataFrame:
    """(section, idx, rule_no, message) of every broken rule; idx is ``ord``.

    ``keys`` names an array column with the keys that a row has (a present null is fine then);
    without it a null counts as missing.  Ends are checked only if any node has an id.
    """
    k = F.col(keys) if keys else None
    n = nodes.select(F.lit("node").alias("section"), F.col("ord").alias("idx"), F.inline(_problems("node", NODE_FIELDS, k, "file_type", FILE_TYPES)))
    e = edges.select(F.lit("edge").alias("section"), F.col("ord").alias("idx"), F.inline(_problems("edge", EDGE_FIELDS, k, "confidence", CONFIDENCES)))
    ids = nodes.where(F.col("id").isNotNull()).select("id").distinct()
    ends = edges.select("ord", F.inline(F.array(*[F.struct(F.lit(len(EDGE_FIELDS) + 1 + i).alias("rule_no"), F.lit(c).alias("end"), F.col(c).alias("name")) for i, c in enumerate(("source", "target"))]))).where("name is not null")
    loose = ends.join(ids, F.col("name") == F.col("id"), "left_anti")
    # one row that says whether there are ids at all
    any_id = ids.limit(1).select(F.lit(True).alias("_any"))
    dangling = loose.join(F.broadcast(any_id)).select(F.lit("edge").alias("section"), F.col("ord").alias("idx"), "rule_no", F.concat("end", F.lit(" '"), "name", F.lit("' names no node")).alias("message"))
    return n.unionByName(e).unionByName(dangling)


#: Scores that a confidence may come with.
INFERRED_SCORES, AMBIGUOUS_SCORES = (0.95, 0.85, 0.75, 0.65, 0.55), (0.1, 0.3)


def fits_rubric(confidence: Column, score: Column) -> Column:
    """Whether a score is one that its confidence may have; missing and unknown ones fit."""
    fits = F.when(confidence == "EXTRACTED", score == 1.0).when(confidence == "INFERRED", score.isin(*INFERRED_SCORES)).when(confidence == "AMBIGUOUS", score.between(*AMBIGUOUS_SCORES))
    return F.coalesce(fits, F.lit(True))


_DOCUMENT = "doc, section, idx, rule_no, message".split(", ")


def validate_documents(documents: DataFrame) -> DataFrame:
    """(doc, section, idx, rule_no, message) of every broken rule of JSON documents (doc, json).

    Structure comes first: a text that is no JSON object has one message; 'nodes' and 'edges' ('links'
    where there are no 'edges') must be there and be lists, their elements objects.  A field is missing
    if its key is; domains are checked for strings; ends must be ids of the same document, if it has any.
    """
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)
    at = lambda v, path, t="variant": F.try_variant_get(v, path, t)
    d = documents.select("doc", F.try_parse_json("json").alias("v"))
    is_object = F.coalesce(kind(F.col("v")) == "OBJECT", F.lit(False))
    d = d.select("doc", "v", is_object.alias("ok"), at(F.col("v"), "$.nodes").alias("nodes"), F.coalesce(at(F.col("v"), "$.edges"), at(F.col("v"), "$.links")).alias("edges"))
    none = F.lit(None).cast("int")
    message = lambda section, idx, no, text: F.struct(F.lit(section).alias("section"), idx.alias("idx"), F.lit(no).alias("rule_no"), text.alias("message"))
    whole = [F.when(~F.col("ok"), message("document", none, 0, F.lit("not a JSON object")))]
    for name in ("nodes", "edges"):
        c = F.col(name)
        whole.append(F.when(F.col("ok") & c.isNull(), message(name, none, 0, F.lit(f"missing key '{name}'"))))
        whole.append(F.when(F.col("ok") & c.isNotNull() & (kind(c) != "ARRAY"), message(name, none, 1, F.lit(f"'{name}' is not a list"))))
    out = d.select("doc", F.inline(F.filter(F.array(*whole), lambda x: x.isNotNull())))
    good = d.where("ok")
    ids = good.select("doc", F.explode(at(F.col("nodes"), "$", "array<variant>")).alias("x")).select("doc", at(F.col("x"), "$.id", "string").alias("id")).where("id is not null").distinct()
    for section, name, fields, domain, allowed in (("node", "nodes", NODE_FIELDS, "file_type", FILE_TYPES), ("edge", "edges", EDGE_FIELDS, "confidence", CONFIDENCES)):
        each = good.select("doc", F.posexplode(at(F.col(name), "$", "array<variant>")).alias("idx", "x"))
        obj = F.coalesce(kind(F.col("x")) == "OBJECT", F.lit(False))
        rules = [F.when(~obj, message(section, F.col("idx"), 0, F.lit(f"{section}: not an object")))]
        rules += [F.when(obj & at(F.col("x"), f"$.{f}").isNull(), message(section, F.col("idx"), 1 + i, F.lit(f"{section}: missing field '{f}'"))) for i, f in enumerate(fields)]
        value = F.when(kind(at(F.col("x"), f"$.{domain}")) == "STRING", at(F.col("x"), f"$.{domain}", "string"))
        rules.append(F.when(obj & value.isNotNull() & ~value.isin(*allowed), message(section, F.col("idx"), 1 + len(fields), F.concat(F.lit(f"{section}: invalid {domain} '"), value, F.lit("'")))))
        out = out.unionByName(each.select("doc", F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull()))))
        if section == "edge":
            ends = each.select("doc", "idx", F.inline(F.array(*[F.struct(F.lit(2 + len(fields) + i).alias("rule_no"), F.lit(c).alias("end"), at(F.col("x"), f"$.{c}", "string").alias("id")) for i, c in enumerate(("source", "target"))]))).where("id is not null")
            loose = ends.join(ids, ["doc", "id"], "left_anti").join(ids.select("doc").distinct(), "doc", "left_semi")
            out = out.unionByName(loose.select("doc", F.lit("edge").alias("section"), "idx", "rule_no", F.concat("end", F.lit(" '"), "id", F.lit("' names no node")).alias("message")))
    return out.select(*_DOCUMENT)


def assert_valid(nodes: DataFrame, edges: DataFrame) -> None:
    """Raises ValueError with up to 50 messages if any rule is broken."""
    found = validate_fragments(nodes, edges).orderBy("section", "idx", "rule_no").limit(50).collect()
    if found:
        raise ValueError("\n".join(f"- {r.section} {r.idx}: {r.message}" for r in found))
