"""Quality rules whose thresholds follow each language and source.

Every document gets counts of words, symbols, repeated lines and repeated
five-word windows.  Ratios of these counts, of documents that pass the base
rule, go into quantile sketches, one for each (language, source): counts in
logarithmic bins, whose quantiles are right to one percent of the value.
Sketches of equal bins merge by adding, so they are an ordinary grouped sum.
Each group's sketch is pooled with that of its language, which weighs as much as
PRIOR documents, and a language's with that of everything, so that a group of few
documents follows the wider ones and a large group its own, without a size at
which that changes.

Thresholds are fences: for the mean length of words, a ratio of quartiles to a
power beyond the quartiles on both sides; for the other ratios, upper quantiles
with the distance from the median added, and what chance adds to the counts of
one document (a standard deviation of clumps of ``unit``, SLACK times).
Documents are filtered by a join with the fences.

Defined results: a null or empty text has no words, so the base rule rejects
it.  Null languages and sources are groups of their own.  Each repeated row is
judged alike.  Extra columns are carried along whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.store import as_table, free_name, small_batches, stored, with_row_id, with_rows
from muster.llm.textwords import WHITE, hashed_docs, ngrams

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = WHITE + bytes(range(0x80, 0xC0))
_GAMMA = 1.02
#: Bin of the value 0, below that of any ratio that occurs.
_ZERO_BIN = -10_000
#: Documents that the wider sketch counts for in a narrower one.
PRIOR = 100
#: Sketch counts are whole numbers of 1 / SCALE documents.
SCALE = 1000
#: The low and high fence of a word's mean length: the quartile ratio, SPREAD at least, to this power beyond the quartiles.
REACH, SPREAD = 6.0, 1.03
#: The other ratios: (count, total, unit: how much of the count comes at once).
RATIOS = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 2 * WINDOW)}
#: Their fence: the UPPER quantile, and so many times its distance from the median; and standard deviations of one document's counts.
UPPER, STRETCH, SLACK = 0.9, 3.0, 3.0
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more."""
    grams = ngrams(words, WINDOW)
    order = np.sort(grams)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(grams, twice))
    change = np.zeros(len(words) + 1, np.int32)
    change[at] += 1
    change[at + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def _line_counts(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return len(lines), len(lines) - len(set(lines))


def counts(text: F.Column) -> F.Column:
    """struct of the counts of one text."""

    @F.arrow_udf("struct<" + ",".join(f"{c}:bigint" for c in _COUNTS) + ">")
    def measure(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in texts:
            out = np.zeros((len(_COUNTS), len(col)), np.int64)
            for i, words in hashed_docs(col, lower=False):
                b = col[i].as_py() or b""
                chars = len(b.translate(None, _NOT_CHARS))
                symbols = len(b) - len(b.translate(None, SYMBOLS))
                out[:, i] = (len(words), chars, symbols, *_line_counts(b), repeat_words(words))
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], _COUNTS)

    return measure(text.cast("binary"))


def base_failed(m: F.Column) -> F.Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def sketches(measured: DataFrame, m: str) -> DataFrame:
    """lang, source, ratio, bin, n: the mergeable sketches of documents that pass the base rule."""
    c = F.col(m)
    over = lambda a, b: F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)
    ratios = {"word_length": ("word_chars", "n_words"), **{k: (a, b) for k, (a, b, _) in RATIOS.items()}}
    pairs = F.array(*[F.struct(F.lit(k).alias("ratio"), over(a, b).alias("x")) for k, (a, b) in ratios.items()])
    rows = measured.where(~base_failed(c)).select("lang", "source", F.explode(pairs).alias("p"))
    bin_ = F.when(F.col("p.x") > 0, F.ceil(F.log("p.x") / math.log(_GAMMA))).otherwise(_ZERO_BIN).cast("int")
    return rows.groupBy("lang", "source", F.col("p.ratio").alias("ratio"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], ps: dict[str, float]) -> DataFrame:
    """Quantiles ``ps`` (by name) of each group of merged sketches."""
    merged = sketch.groupBy(*keys, "ratio", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    merged = merged.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("bin")))
    value = F.when(F.col("bin") == _ZERO_BIN, 0.0).otherwise(F.pow(F.lit(_GAMMA), F.col("bin")) * (2 / (1 + _GAMMA)))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("v")))
    return merged.withColumn("v", value).groupBy(*keys, "ratio").agg(*[at(q).alias(name) for name, q in ps.items()])


def pooled(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """``sketch`` in 1 / SCALE documents, each group with PRIOR documents more of its
    language's distribution, which is pooled with everything's in the same way."""
    of_lang = sketch.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    of_lang = of_lang.withColumn("total", F.sum("n").over(Window.partitionBy("lang", "ratio")))
    of_all = sketch.groupBy("ratio", "bin").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("ratio")))
    of_all = of_all.select("ratio", "bin", F.expr(f"n * {prior * SCALE} div total").alias("n"))
    langs = of_lang.select("lang", "total").distinct()
    # a sketch has some 2,000 bins a ratio at most, however many documents it is of
    far = langs.crossJoin(of_all).select("lang", "ratio", "bin", F.expr(f"n * {prior} div (total + {prior})").alias("n"))
    near = of_lang.select("lang", "ratio", "bin", F.expr(f"n * {prior * SCALE} div (total + {prior})").alias("n"))
    wide = near.unionByName(far).withColumnRenamed("lang", "lang_")
    groups = sketch.select("lang", "source").distinct()
    given = groups.join(wide, F.col("lang").eqNullSafe(F.col("lang_"))).drop("lang_")
    return given.unionByName(sketch.select("lang", "source", "ratio", "bin", (F.col("n") * SCALE).alias("n")))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and one struct of fences for each group."""
    q = quantiles(pooled(sketch, prior), ["lang", "source"], {"q1": 0.25, "q2": 0.5, "q3": 0.75, "high": UPPER})
    of = lambda name: {x: F.max(F.when(F.col("ratio") == name, F.col(x))) for x in ("q1", "q2", "q3", "high")}
    w = of("word_length")
    reach = F.pow(F.greatest(F.lit(SPREAD), w["q2"] / w["q1"], w["q3"] / w["q2"]), F.lit(REACH))
    fences = [(w["q1"] / reach).alias("low_word_length"), (w["q3"] * reach).alias("high_word_length")]
    for name in RATIOS:
        r = of(name)
        fences.append((r["high"] + STRETCH * (r["high"] - r["q2"])).alias(name))
    return q.groupBy("lang", "source").agg(*fences).select("lang", "source", F.struct(*[x for x in ("low_word_length", "high_word_length", *RATIOS)]).alias("fences"))


def verdicts(measured: DataFrame, m: str, name: str) -> DataFrame:
    """``measured`` (stored) with the struct ``name`` of base_failed and kept."""
    lang, source, fences = (free_name(measured, x) for x in ("_lang", "_source", "_fences"))
    found = stored(thresholds(stored(sketches(measured, m), "sketches")), "fences").toDF(lang, source, fences)
    joined = measured.join(found, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left")
    c, f = F.col(m), F.col(fences)
    length = F.try_divide(c["word_chars"], c["n_words"])
    good = (length >= f["low_word_length"]) & (length <= f["high_word_length"])
    for ratio, (count, total, unit) in RATIOS.items():
        usual = f[ratio] * c[total]
        good = good & (c[count] <= usual + SLACK * F.sqrt(unit * usual + unit * unit))
    base = base_failed(c)
    return joined.withColumn(name, F.struct(base.alias("base_failed"), (~base & F.coalesce(good, F.lit(False))).alias("kept"))).drop(lang, source, fences)


def quality_report(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    measured = stored(docs.select("doc_id", "lang", "source", counts(F.col("text")).alias("m")), "counts")
    return verdicts(measured, "m", "v").select("doc_id", *[F.col(f"m.{c}").alias(c) for c in _COUNTS], "v.base_failed", "v.kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay.  Texts are measured once; the numbers of the others' rows take these away."""
    small_batches(docs.sparkSession)
    docs = as_table(docs)
    row = free_name(docs, "row")
    rows = with_row_id(docs.select("text", "lang", "source"), row)
    measured = stored(rows.select(row, "lang", "source", counts(F.col("text")).alias("m")), "counts")
    bad = verdicts(measured, "m", "v").where(~F.col("v.kept")).select(row)
    return with_rows(docs, row, bad, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
