"""Problem 8: repetition inside a single document.

One pass over a text gives the share of its letters that lie in phrases, sentences,
lines or paragraphs that occurred earlier in it.  Documents stand out by robust
multivariate statistics: a minimum-covariance-determinant estimate per language and
source, and the Mahalanobis distance of every document's transformed statistics from
it.  The estimates cover all documents: these are summed up exactly in the cells of a
grid, whose number doesn't grow with the documents, and the concentration steps run
over the cells of a group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.session import checkpoint

#: Words of a phrase, and characters of one in scripts written without spaces.
PHRASE_WORDS, PHRASE_CHARS = 5, 12
#: A run of more letters than this is no word; it is read letter by letter, like scripts without spaces.
LONGEST_WORD = 48
#: Share of repeated letters from which a document counts as repetitive.
LARGE = 0.4
#: Share of a group's documents whose scatter has the least determinant.
KEPT = 0.5
#: Starts of the search for them, from subsets drawn by a fixed seed besides the group's medians, and steps of each at most.
STARTS, STEPS = 12, 100
#: Groups with fewer documents take the estimate of their language, and that of all documents below it.
LEAST = 50
#: 0.975 quantile of chi-squared with 4 degrees of freedom.
CUTOFF = 11.143
#: Width of the grid's cells, and least standard deviation of an estimate.
WIDTH = 1 / 16
STATS = ("share", "phrases", "units", "vocabulary")
_P = len(STATS)

_SPACELESS = "぀-ヿ㐀-䶿一-鿿豈-﫿฀-๿຀-໿က-႟ក-៿ｦ-ﾟ\U00020000-\U0003FFFF"
#: Words, single characters of scripts without spaces, and the ends of sentences, lines and paragraphs.
_TOKENS = re.compile(f"[{_SPACELESS}]|[^\\W\\d_{_SPACELESS}]+|\n\\s*\n|\n|[.!?…]+(?=[\\s\"'”»)\\]]|$)|[。！？｡]")
#: Marks a letter of a run that is too long for a word.
_LETTER = "\0"
_ONE = re.compile(f"[{_SPACELESS}{_LETTER}]")


def _spelled(words: list[str], ends: list[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """The words with runs of too many letters spelled out, and the ends moved accordingly."""
    out, at = [], [0]
    for w in words:
        out += [_LETTER + c for c in w] if len(w) > LONGEST_WORD else [w]
        at.append(len(out))
    return out, [(at[i], what) for i, what in ends]


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """(letters, repeated, in repeated phrases, in repeated sentences, lines or paragraphs, units, distinct units)."""
    tokens = _TOKENS.findall(text.replace("\r\n", "\n").replace("\r", "\n").casefold())
    words, ends = [], []
    for t in tokens:
        if t[0].isalpha() or t[0].isalnum():
            words.append(t)
        else:
            ends.append((len(words), 0 if t[0] != "\n" else 1 if len(t) == 1 else 2))
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, 0
    ends.append((n, 2))
    sizes = [len(w) for w in words]
    letters = sum(sizes)
    if max(sizes) > LONGEST_WORD:
        words, ends = _spelled(words, ends)
        n, sizes = len(words), [1 if w[0] == _LETTER else len(w) for w in words]

    phrase = bytearray(n)
    grams = list(zip(*(words[i:] for i in range(PHRASE_WORDS))))
    if len(set(grams)) < len(grams):
        seen: set = set()
        add, k = seen.add, PHRASE_WORDS
        mark = b"\1" * PHRASE_WORDS
        for i, g in enumerate(grams):
            if g in seen:
                # a phrase in a script without spaces is longer than five of its characters
                if not any(map(_ONE.match, g)):
                    phrase[i : i + k] = mark
            else:
                add(g)
    if any(map(_ONE.match, words)):
        long: set = set()
        k = PHRASE_CHARS
        for i in range(n - k + 1):
            g = "".join(words[i : i + k])
            if g in long:
                phrase[i : i + k] = b"\1" * k
            else:
                long.add(g)

    unit = bytearray(n)
    for level in (0, 1, 2):
        known: set = set()
        begin = 0
        for at, what in ends:
            if what >= level:
                if at > begin:
                    key = "".join(words[begin:at])
                    if key in known:
                        unit[begin:at] = b"\1" * (at - begin)
                    else:
                        known.add(key)
                begin = at
    in_phrases = sum(s for s, p in zip(sizes, phrase) if p) if 1 in phrase else 0
    in_units = sum(s for s, p in zip(sizes, unit) if p) if 1 in unit else 0
    repeated = sum(s for s, p, u in zip(sizes, phrase, unit) if p or u) if in_phrases or in_units else 0
    return letters, repeated, in_phrases, in_units, n, len(set(words))


SCHEMA = "doc_id bigint, lang string, source string, n_letters bigint, n_repeated bigint, share double, x array<double>"


def _statistics(letters: int, repeated: int, phrases: int, units: int, n: int, distinct: int) -> list[float]:
    """The transformed vector: arcsines of roots of shares, and how far the vocabulary falls short of its usual growth."""
    if not letters:
        return [0.0] * _P
    arc = lambda a: math.asin(math.sqrt(min(1.0, a / letters)))
    return [arc(repeated), arc(phrases), arc(units), math.log1p(n) - math.log1p(distinct)]


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = [measure(t) if t else (0, 0, 0, 0, 0, 0) for t in b.column(3).to_pylist()]
        yield pa.record_batch(
            [b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in m], pa.int64()), pa.array([x[1] for x in m], pa.int64()),
             pa.array([x[1] / x[0] if x[0] else 0.0 for x in m], pa.float64()), pa.array([_statistics(*x) for x in m], pa.list_(pa.float64()))],
            names=["doc_id", "lang", "source", "n_letters", "n_repeated", "share", "x"],
        )


def repetition_shares(documents: DataFrame) -> DataFrame:
    """``SCHEMA`` for every row of ``documents`` (doc_id, text, lang, source): the share of letters in repeated content.

    Null, empty and letterless texts have share 0.  Case, punctuation, digits and spacing don't
    count; the first occurrence isn't repeated.  Texts are read whole.
    """
    cols = [F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]]
    return documents.select(*cols).mapInArrow(_measure_batches, SCHEMA)


_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
_SUMS = ["n", *[f"s{i}" for i in range(_P)], *[f"p{i}{j}" for i, j in _PAIRS]]


def _grid(lettered: DataFrame) -> DataFrame:
    """(level, lang, source, cell, sums): documents in cells of the grid, per source (2), per language (1) and of all (0).

    Rows are summed before they are shuffled; a cell has its number, sums and sums of products.
    """
    x = [F.col("x")[i] for i in range(_P)]
    # arcs take less than 26 cells each; the logarithm is below 40 for any text
    cell = sum((F.shiftleft(F.floor(x[i] / WIDTH).cast("bigint"), 10 * i) for i in range(1, _P)), F.floor(x[0] / WIDTH).cast("bigint"))
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(_P)], *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS]]
    finest = lettered.groupBy("lang", "source", cell.alias("cell")).agg(*sums)
    no = F.lit(None).cast("string")
    levels = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, a, b in ((2, F.col("lang"), F.col("source")), (1, F.col("lang"), no), (0, no, no))])
    spread = finest.select(F.explode(levels).alias("g"), "cell", *_SUMS)
    return spread.groupBy("g", "cell").agg(*[F.sum(c).alias(c) for c in _SUMS]).select("g.level", "g.lang", "g.source", "cell", *_SUMS)


def _chi2(x: float, degrees: int) -> float:
    """Distribution function of chi-squared for an even number of degrees of freedom."""
    term = total = math.exp(-x / 2)
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - total


def _consistency(kept: float, below: float | None = None) -> float:
    """What makes the scatter of the nearest part ``kept`` of a normal sample that of the whole; ``below`` is its limit if known."""
    if below is None:
        lo, hi = 0.0, 100.0
        for _ in range(60):
            below = (lo + hi) / 2
            lo, hi = (below, hi) if _chi2(below, _P) < kept else (lo, below)
    return kept / _chi2(below, _P + 2)


def minimum_covariance(n: np.ndarray, s: np.ndarray, p: np.ndarray, kept: float = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the part ``kept`` with the least determinant, then of all that lie within the cutoff of it.

    n, s, p: number, sums and sums of products of every cell.  A cell lies where its mean lies; the last
    one that is taken counts in part, so that exactly the wanted part is kept.
    """
    mean, floor = s / n[:, None], np.eye(_P) * WIDTH**2
    total = n.sum()

    def fit(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = weight @ n
        center = (weight[:, None] * s).sum(0) / k
        return center, (weight[:, None, None] * p).sum(0) / k - np.outer(center, center)

    def distances(center: np.ndarray, scatter: np.ndarray) -> np.ndarray:
        d = mean - center
        return np.einsum("ki,ij,kj->k", d, np.linalg.inv(scatter + floor), d)

    def nearest(d: np.ndarray) -> np.ndarray:
        order = np.argsort(d, kind="stable")
        before = np.cumsum(n[order]) - n[order]
        weight = np.empty(len(n))
        weight[order] = np.clip((kept * total - before) / n[order], 0, 1)
        return weight

    def median(x: np.ndarray) -> float:
        order = np.argsort(x, kind="stable")
        return x[order][np.searchsorted(np.cumsum(n[order]), total / 2)]

    middle = np.array([median(mean[:, i]) for i in range(_P)])
    spread = np.array([median(np.abs(mean[:, i] - middle[i])) for i in range(_P)])
    begins = [(middle, np.diag((1.4826 * spread) ** 2))]
    draw = np.random.default_rng(0)
    for _ in range(STARTS):
        few = draw.choice(len(n), size=_P + 1, p=n / total)
        begins.append((mean[few].mean(0), np.cov(mean[few].T, bias=True)))
    best = None
    for center, scatter in begins:
        size = math.inf
        for _ in range(STEPS):
            center, scatter = fit(nearest(distances(center, scatter)))
            now = np.linalg.slogdet(scatter + floor)[1]
            if now >= size - 1e-12:
                break
            size = now
        if best is None or size < best[0] - 1e-12:
            best = size, center, scatter
    _, center, scatter = best
    scatter = scatter * _consistency(kept)
    within = (distances(center, scatter) <= CUTOFF).astype(float)
    if within.any():
        center, scatter = fit(within)
        scatter = scatter * _consistency(0.975, CUTOFF)
    return center, scatter + floor


def _estimate(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate of one group, null for fewer than LEAST documents."""
    pdf = pdf.sort_values("cell")
    n = pdf["n"].to_numpy()
    center = precision = None
    if n.sum() >= LEAST:
        p = np.zeros((len(n), _P, _P))
        for i, j in _PAIRS:
            p[:, i, j] = p[:, j, i] = pdf[f"p{i}{j}"]
        center, scatter = minimum_covariance(n, pdf[[f"s{i}" for i in range(_P)]].to_numpy(), p)
        center, precision = center.tolist(), np.linalg.inv(scatter).ravel().tolist()
    first = pdf.iloc[0]
    return pd.DataFrame({"level": [first["level"]], "lang": [first["lang"]], "source": [first["source"]], "center": [center], "precision": [precision]})


def _distance(x: Column, center: Column, precision: Column) -> Column:
    """Squared Mahalanobis distance of x from center."""
    d = F.zip_with(x, center, lambda a, b: a - b)
    rows = F.transform(F.sequence(F.lit(0), F.lit(_P - 1)), lambda i: F.aggregate(F.zip_with(d, F.slice(precision, i * _P + 1, _P), lambda a, b: a * b), F.lit(0.0), lambda u, v: u + v))
    return F.aggregate(F.zip_with(d, rows, lambda a, b: a * b), F.lit(0.0), lambda u, v: u + v)


def estimates(shares: DataFrame) -> DataFrame:
    """(lang, source, level, center, precision): the estimate that the documents of each language and source are held against.

    It is the finest one of source (level 2), language (1) and all documents (0) that exists (LEAST) and
    is no outlier itself: a group whose centre lies beyond the cutoff of the next coarser estimate is
    repetitive throughout and takes that one.  The coarsest (-1) is a text that repeats nothing, with the
    grid's width as scatter.
    """
    found = _grid(shares.where("n_letters > 0")).groupBy("level", "lang", "source").applyInPandas(_estimate, "level int, lang string, source string, center array<double>, precision array<double>")
    found = checkpoint(found)
    of = lambda k, *names: found.where(F.col("level") == k).select(*[F.col(c).alias(c + str(k)) for c in ("lang", "source", "center", "precision")]).drop(*names)
    joined = of(2).join(of(1, "source1"), F.col("lang2").eqNullSafe(F.col("lang1")), "left").crossJoin(F.broadcast(of(0, "lang0", "source0")))  # one row
    nothing = [F.array(*[F.lit(0.0)] * _P), F.array(*[F.lit(1.0 / WIDTH**2 if i == j and i < 3 else 0.0) for i in range(_P) for j in range(_P)])]
    level, center, precision = F.lit(-1), *nothing
    for k in (0, 1, 2):
        good = F.coalesce(_distance(F.col(f"center{k}"), center, precision) <= CUTOFF, F.lit(False))
        level, center, precision = (F.when(good, new).otherwise(old) for new, old in ((F.lit(k), level), (F.col(f"center{k}"), center), (F.col(f"precision{k}"), precision)))
        joined = joined.select("*", level.alias(f"_l{k}"), center.alias(f"_c{k}"), precision.alias(f"_p{k}"))
        level, center, precision = F.col(f"_l{k}"), F.col(f"_c{k}"), F.col(f"_p{k}")
    return joined.select(F.col("lang2").alias("lang"), F.col("source2").alias("source"), level.alias("level"), center.alias("center"), precision.alias("precision"))


def robust_distances(shares: DataFrame) -> DataFrame:
    """``shares`` with distance: the squared robust Mahalanobis distance from the ``estimates`` of the document's language and source.

    Documents without letters take no part in the estimates and have a null distance.
    """
    known = estimates(shares).select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "center", "precision")
    on = F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))
    distance = F.when(F.col("n_letters") > 0, _distance(F.col("x"), F.col("center"), F.col("precision")))
    return shares.join(known, on, "left").withColumn("distance", distance).drop("_l", "_s", "center", "precision")


def repetitive_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, share, distance) of the documents that their distance rejects and whose share, checked exactly, is large."""
    shares = checkpoint(repetition_shares(documents))
    return robust_distances(shares).where((F.col("distance") > CUTOFF) & (F.col("share") >= LARGE)).select("doc_id", "share", "distance")
