"""Scores of predicted peaks, boundaries and spans against reference intervals, for all files at once.

Inputs are long tables keyed by ``file_id`` (and, for references, ``active``); each evaluator gives
one row a file with counts, the error rate and the lists of times behind the counts.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxloom.functions.expressions import iou, stem

#: Vowels by ARPAbet name, plain vowels, and syllabic consonants.
VOWELS = (
    "AA", "AE", "AH", "AO", "AW", "AX", "AY", "EH", "ER", "EY", "IH", "IX", "IY", "OW", "OY", "UH", "UW",
    "A", "E", "I", "O", "U",
    "EL", "EM", "EN", "ENG",
)
#: Vowels of Kono, in several Unicode forms of one letter.
KONO_VOWELS = (
    "a","aa","à","àà","àá","á","áà","áá","ã","ã́",
    "à","àà","àá","á","áá","ã","ɑ̀",
    "e","è","é","éè","è","èè","é",
    "i","ì","ìì","ìí","í","ì","ìí","í","íí","ɪ́",
    "ḿ","ń","ɱ́",
    "o","ò","ò̃","ó","õ","õ̀","ṍ","ò","ó","õ","õ̀",
    "u","ù","ú","u̟","ù","ùù","ú","ʉ́","ʌ́",
    "ɔ","ɔɔ","ɔ̀","ɔ́","ɔ́ɔ̀","ɔ́ɔ́","ɔ̟́",
    "ɛ","ɛ̀","ɛ̝̀","ɛ́","ɛ́ɛ́","ɛ̝́ɛ̝́","ɛ̝","ɛ̝̀",
)
#: A label that holds one of these is not speech. The last but one keeps its backslashes.
MARKERS = ("h#", "sil", "sp", "\\{SIL\\}", "_unknown")
TOLERANCE = 0.05


def is_vowel(label: Column, vowels: Iterable[str] = VOWELS) -> Column:
    """The label, its lower or upper case, or its letters in upper case, is in ``vowels``."""
    known = list(vowels)
    forms = (label, F.lower(label), F.upper(label), F.regexp_replace(F.upper(label), "[^a-zA-Z]", ""))
    return reduce(lambda a, b: a | b, (f.isin(known) for f in forms))


def is_deleted(label: Column, markers: Iterable[str] = MARKERS) -> Column:
    """Blank, or holding a marker anywhere."""
    return reduce(lambda a, b: a | b, (F.contains(label, F.lit(m)) for m in markers), F.trim(label) == "")


def vocalic_intervals(tiers: DataFrame, vowels: Iterable[str] = VOWELS) -> DataFrame:
    return tiers.filter(is_vowel(F.col("text"), vowels))


def syllable_intervals(tiers: DataFrame, markers: Iterable[str] = MARKERS) -> DataFrame:
    """All intervals with ``active``: false where the label is blank or marked."""
    return tiers.withColumn("active", ~is_deleted(F.col("text"), markers))


def reference_with_deletions(active: DataFrame, deleted: DataFrame) -> DataFrame:
    return active.withColumn("active", F.lit(True)).unionByName(deleted.withColumn("active", F.lit(False)))


def boundary_set(spans: DataFrame, start: str = "start", end: str = "end", key: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """Distinct starts and ends."""
    return spans.select(*key, F.explode(F.array(start, end)).alias("t")).distinct()


def with_all_files(rows: DataFrame, *sources: DataFrame) -> DataFrame:
    """``rows`` by file, and a row for every file of the sources."""
    files = reduce(lambda a, b: a.unionByName(b), (s.select("file_id") for s in sources)).distinct()
    return files.join(rows, "file_id", "left")


def listed(when: Column, value: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(when, value)))


def evaluate_boundaries(predicted: DataFrame, reference: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Each predicted boundary (file_id, t) with the nearest reference (file_id, t, active), if each is the other's nearest.

    On ties the smaller time, and an active copy before a deleted one, comes first. A match with a
    deleted boundary counts neither way. TER = (Ins + Del) / max(TP + Del, 1).
    """
    preds = predicted.select("file_id", F.col("t").alias("p")).distinct()
    refs = reference.select(F.col("file_id").alias("_f"), F.col("t").alias("r"), "active").distinct()
    near = preds.join(refs, (F.col("file_id") == F.col("_f")) & (F.abs(F.col("p") - F.col("r")) <= tolerance)).drop("_f")
    near = near.withColumn("d", F.abs(F.col("p") - F.col("r")))
    rank = lambda by, *tie: F.row_number().over(W.partitionBy("file_id", *by).orderBy("d", *tie))
    pairs = near.withColumn("a", rank(("p",), F.desc("active"), "r")).withColumn("b", rank(("r", "active"), "p")).filter("a = 1 AND b = 1")
    hit = pairs.select("file_id", "p", "r", "active")
    ins = preds.join(hit.select("file_id", "p"), ["file_id", "p"], "left_anti")
    dele = refs.filter("active").select(F.col("_f").alias("file_id"), "r").join(hit.filter("active").select("file_id", "r"), ["file_id", "r"], "left_anti")
    kinds = hit.filter("active").select("file_id", F.lit("TP").alias("kind"), F.col("p").alias("t"))
    kinds = kinds.unionByName(ins.select("file_id", F.lit("Ins").alias("kind"), F.col("p").alias("t"))).unionByName(dele.select("file_id", F.lit("Del").alias("kind"), F.col("r").alias("t")))
    of = lambda k: F.col("kind") == k
    counts = kinds.groupBy("file_id").agg(
        *(F.count_if(of(k)).alias(k) for k in ("TP", "Ins", "Del")),
        *(listed(of(k), F.col("t")).alias(n) for k, n in (("TP", "matches"), ("Ins", "insertions"), ("Del", "deletions"))),
    )
    return scored(with_all_files(counts, predicted, reference), F.greatest(F.col("TP") + F.col("Del"), F.lit(1)))


def evaluate_nuclei(peaks: DataFrame, intervals: DataFrame, window: float = TOLERANCE) -> DataFrame:
    """Peaks (file_id, ord, t) in reference intervals (file_id, xmin, xmax) widened by ``window``.

    An interval is matched by its first peak; further ones are extra. Ins counts extra values and
    peaks in no interval; a value may match one interval and be extra in another. TER = (Ins + Del) / intervals.
    """
    spans = intervals.select("file_id", "xmin", "xmax", F.row_number().over(W.partitionBy("file_id").orderBy("xmin", "xmax")).alias("k"))
    right = spans.withColumnRenamed("file_id", "_f")
    inside = (F.col("t") >= F.col("xmin") - window) & (F.col("t") <= F.col("xmax") + window)
    met = peaks.select("file_id", "ord", "t").join(right, (F.col("file_id") == F.col("_f")) & inside).drop("_f")
    met = met.withColumn("rn", F.row_number().over(W.partitionBy("file_id", "k").orderBy("ord")))
    hits = met.filter("rn = 1").groupBy("file_id").agg(F.count("*").alias("TP"), F.array_sort(F.collect_set("t")).alias("matches"))
    values = met.groupBy("file_id", "t").agg(F.bool_or(F.col("rn") > 1).alias("extra"), F.bool_or(F.col("rn") == 1).alias("match"))
    extra = values.filter("extra").groupBy("file_id").agg(F.count("*").alias("n_extra"), F.array_sort(F.collect_list(F.when(~F.col("match"), F.col("t")))).alias("extra_values"))
    lost = peaks.select("file_id", "t").join(values.select("file_id", "t"), ["file_id", "t"], "left_anti")
    lost = lost.groupBy("file_id").agg(F.count("*").alias("n_lost"), F.array_sort(F.collect_list("t")).alias("lost"))
    total = spans.groupBy("file_id").agg(F.count("*").alias("n"))
    rows = with_all_files(hits, peaks, intervals)
    for other in (extra, lost, total):
        rows = rows.join(other, "file_id", "left")
    none = F.array().cast("array<double>")
    rows = rows.select(
        "file_id",
        F.coalesce("TP", F.lit(0)).alias("TP"),
        (F.coalesce("n_extra", F.lit(0)) + F.coalesce("n_lost", F.lit(0))).alias("Ins"),
        (F.coalesce("n", F.lit(0)) - F.coalesce("TP", F.lit(0))).alias("Del"),
        F.coalesce("matches", none).alias("matches"),
        F.array_sort(F.concat(F.coalesce("extra_values", none), F.coalesce("lost", none))).alias("insertions"),
        F.coalesce("n", F.lit(0)).alias("_n"),
    )
    missed = right.join(met.select(F.col("file_id").alias("_m"), F.col("k").alias("_k")).distinct(), (F.col("_f") == F.col("_m")) & (F.col("k") == F.col("_k")), "left_anti")
    missed = missed.groupBy(F.col("_f").alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("xmin", "xmax"))).alias("deletions"))
    rows = rows.join(missed, "file_id", "left")
    return rows.withColumn("Sub", F.lit(None).cast("long")).withColumn("TER", F.coalesce(F.try_divide(F.col("Ins") + F.col("Del"), F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0.0))).drop("_n")


def scored(rows: DataFrame, under: Column) -> DataFrame:
    """Missing counts and lists filled, and the error rate."""
    none = F.array().cast("array<double>")
    filled = rows.select(
        "file_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("TP", "Ins", "Del")),
        F.lit(None).cast("long").alias("Sub"),
        *(F.coalesce(c, none).alias(c) for c in ("matches", "insertions", "deletions")),
    )
    return filled.withColumn("TER", (F.col("Ins") + F.col("Del")) / under)


def best_span_overlap(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """For each predicted span the reference of greatest overlap ratio, the first on ties; 0 and null where none meets."""
    right = reference.select(F.col("file_id").alias("_f"), F.col("start").alias("r0"), F.col("end").alias("r1"))
    meet = (F.col("start") < F.col("r1")) & (F.col("r0") < F.col("end"))
    met = predicted.select("file_id", "start", "end").join(right, (F.col("file_id") == F.col("_f")) & meet, "left")
    score = F.coalesce(iou(F.col("start"), F.col("end"), F.col("r0"), F.col("r1")), F.lit(0.0))
    best = F.max(F.struct(score.alias("iou"), (-F.col("r0")).alias("a"), (-F.col("r1")).alias("b"))).alias("best")
    return met.groupBy("file_id", "start", "end").agg(best).select("file_id", "start", "end", F.col("best.iou").alias("iou"), (-F.col("best.a")).alias("ref_start"), (-F.col("best.b")).alias("ref_end"))


def flatten(results: DataFrame, methods: list[str], path_col: str = "path") -> DataFrame:
    """One row a file and method from struct columns named after the methods; missing results give no row."""
    parts = [F.when(F.col(m).isNotNull(), F.struct(F.lit(m).alias("eval_method"), *(F.col(f"{m}.{c}").alias(c) for c in ("TP", "Ins", "Del", "Sub", "TER")))) for m in methods]
    rows = results.select(F.col(path_col).alias("_path"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("r"))
    return rows.select(stem(F.col("_path")).alias("file_id"), "r.*")


def aggregate(rows: DataFrame, dataset: str) -> DataFrame:
    """Counts summed by method, with precision, recall, F1 and rates per reference item; null where nothing is counted."""
    counts = rows.groupBy("eval_method").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("TP", "Ins", "Del", "Sub")))
    total = F.col("TP") + F.col("Del") + F.col("Sub")
    p = F.try_divide(F.col("TP"), F.col("TP") + F.col("Ins") + F.col("Sub"))
    r = F.try_divide(F.col("TP"), total)
    rate = lambda c: F.try_divide(F.col(c), total)
    return counts.select(
        F.lit(dataset).alias("dataset"),
        "eval_method",
        *(rate(c).alias(c) for c in ("TP", "Ins", "Del", "Sub")),
        (rate("Ins") + rate("Del") + rate("Sub")).alias("TER"),
        p.alias("Precision"),
        r.alias("Recall"),
        F.try_divide(2 * p * r, p + r).alias("F1"),
        total.alias("Total"),
    )
