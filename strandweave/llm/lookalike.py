"""Problem 5: one consistent form for text that looks the same.

Labels are mapped by built-in string functions (letters of other scripts by a table of
confusables; width, style and ligatures by Unicode's compatibility forms; spaces and
invisible characters), grouped under Spark's accent- and
case-sensitive Unicode collation, which takes composed and decomposed letters as
equal, and every class gets one deterministic member.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters whose usual glyphs are those of a Latin letter, after Unicode's table of confusables (UTS 39).
# Only letters that can't be told apart are taken; accents, case and digits stay differences.
LOOKALIKES = {
    "Latin": ("ɑɡ", "ag"),
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХԚԜаесһіјорԛѕԝхуԁѵӏҮѴүԌҺ", "ABESIJKMHOPCTYXQWaechijopqswxydvlYVyGh"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριγυϲϳϹͿϜ", "ABEZHIKMNOPTYXavopiyucjCJF"),
    "Armenian": ("օսոհցզԼՕՍՏ", "ounhgqLOUS"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏞᎷᏢᏒᏚᎢᏙᎳᏃᎥᎡᏀᏦ", "ABCDEHJLMPRSTVWZiRGK"),
    "Coptic": ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "ABEHIKMNOPCTYXopc"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
# Digraphs written as two letters by no compatibility form that this map takes.
LIGATURES = {"ﬅ": "st"}
#: Compatibility forms that look like what they stand for (not: raised, lowered, circled, squared, vertical and so on).
SAME_LOOK = ("<font>", "<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Compatibility forms that do not: long s, and variant shapes of Greek letters.
OTHER_LOOK = "ſϐϑϒϓϔϕϖϰϱϲϴϵϹ"
#: Characters without a glyph of their own: formats, controls, fillers, joiners and variation selectors.
#: The signs that enclose Arabic, Syriac and Kaithi numbers are formats too, but visible.
INVISIBLE = r"[\p{Cf}\p{Cc}&&[^\t\n\r\x0B\f\x85\u0600-\u0605\u06DD\u070F\u0890\u0891\u08E2\x{110BD}\x{110CD}]]|[͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️\x{E0100}-\x{E01EF}\x{FFF0}-\x{FFF8}]"
COLLATION = "UNICODE"


@functools.cache
def character_map() -> tuple[dict[str, str], dict[str, str]]:
    """What one character becomes: a character, or several."""
    one: dict[str, str] = {}
    for letters, latin in LOOKALIKES.values():
        assert len(letters) == len(latin), (letters, latin)
        one |= dict(zip(letters, latin))
    many = dict(LIGATURES)
    # accented letters on look-alike bases, by their canonical decomposition
    for code in [*range(0x370, 0x530)]:
        c = chr(code)
        if c not in one and len(d := unicodedata.normalize("NFD", c)) > 1 and d[0] in one:
            to = unicodedata.normalize("NFC", one[d[0]] + d[1:])
            (one if len(to) == 1 else many)[c] = to
    # width, style and ligatures, by their compatibility forms
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00)]:
        c = chr(code)
        tag = unicodedata.decomposition(c).split(" ")[0]
        if tag not in SAME_LOOK or c in one or c in OTHER_LOOK or c in LIGATURES:
            continue
        to = unicodedata.normalize("NFKC", c)
        if to[0] != " ":
            to = "".join(one.get(x, x) for x in to)
            (one if len(to) == 1 else many)[c] = to
    one["ﾞ"], one["ﾟ"] = "゙", "゚"
    # kinds of space
    for code in range(0x3001):
        if unicodedata.category(chr(code)) == "Zs" or chr(code) in "\t\n\r\x0b\x0c\x85\u2028\u2029":
            one[chr(code)] = " "
    one.pop(" ")
    # visible, but ignored by the collation: private characters stand for them in the class
    one |= {c: chr(0xE000 + i) for i, c in enumerate("\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2")}
    return one, many


@F.pandas_udf(T.StringType())
def _composed(labels: pd.Series) -> pd.Series:
    """Characters that become several, and canonical composition; the collation alone needs marks in canonical order."""
    many = str.maketrans(character_map()[1])
    return labels.map(lambda x: unicodedata.normalize("NFC", x.translate(many)), na_action="ignore")


def looks(label: Column) -> Column:
    """The label with every character replaced by the plain one that it looks like."""
    one, _ = character_map()
    return _composed(F.translate(F.regexp_replace(label, INVISIBLE, ""), "".join(one), "".join(one.values())))


def mapped_labels(nodes: DataFrame, *keys: str) -> DataFrame:
    """``keys``, label and its mapped form ``looks`` for every row with a label."""
    rows = nodes.where(F.col("label").isNotNull()).select(*keys, "label")
    plain = F.col("label").rlike(r"^[\x20-\x7E]*$")
    return rows.where(plain).withColumn("looks", F.col("label")).unionByName(
        rows.where(~plain).withColumn("looks", looks(F.col("label")))
    )


def label_classes(nodes: DataFrame) -> DataFrame:
    """(repo, looks, canonical, n_labels): every mapped form with the member that stands for its class.

    The member is the first label in byte order among those that mapping leaves as they are,
    else the first label.  Only distinct forms are grouped, so a label held by many nodes is one row.
    """
    forms = (
        mapped_labels(nodes, "repo")
        .groupBy("repo", "looks")
        .agg(F.min(F.struct((F.col("label") != F.col("looks")).alias("odd"), F.col("label").alias("label"))).alias("best"), F.min("label").alias("low"), F.max("label").alias("high"))
    )
    key = F.collate(F.col("looks"), COLLATION)
    classes = forms.groupBy("repo", key.alias("class")).agg(
        F.min("best").alias("best"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("looks").alias("forms")
    )
    return classes.select("repo", F.explode("forms").alias("looks"), F.col("best.label").alias("canonical"), (F.col("low") != F.col("high")).alias("differs"))


def canonical_labels(nodes: DataFrame) -> DataFrame:
    """(ord, repo, id, label, canonical) of every row of ``nodes`` (ord, repo, id, label).

    A null label stays null, an empty one empty; labels of a null repo form classes among themselves.
    """
    classes = label_classes(nodes).select(F.col("repo").alias("_r"), F.col("looks").alias("_l"), "canonical")
    mapped = mapped_labels(nodes, "ord", "repo", "id").join(classes, F.col("repo").eqNullSafe(F.col("_r")) & (F.col("looks") == F.col("_l")), "left").select("ord", "repo", "id", "label", "canonical")
    return mapped.unionByName(nodes.where(F.col("label").isNull()).select("ord", "repo", "id", "label", F.lit(None).cast("string").alias("canonical")))


def lookalike_pairs(nodes: DataFrame) -> DataFrame:
    """(id_a, id_b): different ids of a repo, id_a < id_b, whose labels differ but look the same.

    Ids, repos and labels that are null play no part; pairs come once.  Only classes that hold
    different labels are joined, label by label and not node by node.
    """
    named = nodes.where(F.col("id").isNotNull() & F.col("repo").isNotNull())
    classes = label_classes(named).where("differs").select("repo", "looks", F.col("canonical").alias("class"))
    rows = mapped_labels(named, "repo", "id").join(classes, ["repo", "looks"]).select("repo", "class", "id", "label").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.repo") == F.col("b.repo")) & (F.col("a.class") == F.col("b.class")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.label") != F.col("b.label"))
    return a.join(b, on).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
