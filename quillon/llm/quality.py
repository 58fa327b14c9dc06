"""Quality rules whose cutoffs are chosen on labelled holdouts with a guaranteed false-rejection rate.

Every rule compares one measure of a document with a cutoff. For each stratum (language) and rule the
cutoffs are tried from the mildest on. A cutoff holds if the exact binomial (Clopper-Pearson) test
rejects "the rule drops over ``alpha`` of the good documents" at the level ``delta`` divided by the
number of strata times rules (Bonferroni); within a rule the order of tests is fixed in advance, so
testing stops at the first cutoff that fails and no further correction is due. All cutoffs that hold are good
at once, so any choice among them keeps the guarantee: taken is the one that drops the most bad documents, then
the fewest good ones, then the strictest. A rule that has none, or drops no bad document that the rules before it
leave, is off in that stratum. All labelled rows take part, equal texts of a stratum once, as copies are no further draws.

``alpha`` can be certified from about ``log(1 / level) / alpha`` good texts on. A stratum with fewer has the alpha that its
number of good texts can certify, up to ``LOOSEST``; that number is fixed before any outcome is looked at, so the
guarantee stands at that alpha. It holds for each rule: all rules of a stratum together falsely reject at most as many times
alpha as rules are on there.

Edge cases: a null text has no words, so the base rules drop it; very long texts are measured whole; a null stratum is a
stratum of its own; documents of strata without labels meet only the base rules; of several labels of a text the good
one counts; ties between cutoffs go to the strictest; an empty label table switches all rules off; an empty table of
documents gives an empty result; rows that repeat are judged each; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, session, text_bytes

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Rule name, measure as SQL; larger is worse. Cutoffs run from CUTS[0] (mildest) down.
RULES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "word_length_off": "abs(word_chars / greatest(n_words, 1) - 6) / 6",
}
CUTS = [round(2 - 0.05 * i, 2) for i in range(40)]
#: The largest share of good documents that a rule may drop in a stratum with few labels.
LOOSEST = 0.05


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows, lines with a word."""
    words = text.split()
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    symbols = sum(text.count(s.encode()) for s in SYMBOLS)
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, dup, repeated, len(lines)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns, none of which may have a measure's name, and the measures."""
    session(docs.sparkSession)
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measures, text_bytes(batch.column(at))), strict=True)) or [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(x), pa.int64()) for x in found)], names=[*names, *MEASURES])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p); 1 where k is above the mean, as no test rejects there."""
    if k > n * p:
        return 1.0
    log_top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term, i = 0.0, 1.0, k
    while i >= 0 and term > 1e-18:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, math.exp(log_top) * total)


def alpha_of(n: int, alpha: float, level: float) -> float:
    """The alpha that n good documents can certify at the level, if they drop none: at least ``alpha``, at most LOOSEST."""
    return min(max(alpha, 1 - level ** (1 / n)), max(alpha, LOOSEST)) if n else alpha


def certified_cutoffs(counts: list[tuple[str | None, int, dict[str, list[int]]]], alpha: float, delta: float) -> dict[str | None, dict[str, list[float]]]:
    """The cutoffs that hold, mildest first. counts: stratum, good documents, and by rule how many of them each cutoff of CUTS drops."""
    level = delta / max(1, len(counts) * len(RULES))
    held: dict[str | None, dict[str, list[float]]] = {}
    for stratum, n, dropped in counts:
        held[stratum] = {}
        for rule in RULES:
            failed = next((i for i, k in enumerate(dropped[rule]) if n == 0 or binomial_tail(k, n, alpha_of(n, alpha, level)) > level * (1 + 1e-9)), len(CUTS))
            held[stratum][rule] = CUTS[:failed]
    return held


def best_cutoff(cuts: list[float], bad: list[int], good: list[int]) -> float | None:
    """Of certified cutoffs: the most bad documents dropped, then the fewest good ones, then the strictest; None if no bad one goes."""
    ranked = [(bad[i], -good[i], i) for i in range(len(cuts))]
    best = max(ranked, default=(0, 0, 0))
    return cuts[best[2]] if best[0] else None


def calibrate(measures_and_labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> dict[str | None, dict[str, float]]:
    """Cutoffs by stratum from rows with measures, ``quality`` (1 good, 0 bad) and the stratum.

    Documents that fail the base rules go anyway and take no part. Rules are taken in turn, and each is
    chosen by the bad documents that those before it leave. Reaches the driver: a row per stratum and rule.
    """
    rows = materialise(measures_and_labels.filter(F.col("quality").isin(0, 1) & ~base_failed()), "labelled")
    key = F.col(stratum).alias("stratum")

    def counted(part: DataFrame, rules: list[str]) -> dict[str | None, tuple[int, dict[str, list[int]]]]:
        dropped = [F.coalesce(F.sum((F.expr(RULES[r]) > F.lit(cut)).cast("long")), F.lit(0)).alias(f"{r}_{i}") for r in rules for i, cut in enumerate(CUTS)]
        found = part.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *dropped).collect()
        return {r["stratum"]: (r["n"], {x: [r[f"{x}_{i}"] for i in range(len(CUTS))] for x in rules}) for r in found}

    good = counted(rows.filter("quality = 1"), list(RULES))
    held = certified_cutoffs([(s, n, dropped) for s, (n, dropped) in sorted(good.items(), key=lambda x: str(x[0]))], alpha, delta)
    chosen: dict[str | None, dict[str, float]] = {s: {} for s in held}
    for rule in RULES:
        bad = counted(rows.filter("quality = 0").filter(verdict(chosen, stratum)), [rule])
        for s, rules in held.items():
            cut = best_cutoff(rules[rule], bad[s][1][rule] if s in bad else [0] * len(CUTS), good[s][1][rule])
            if cut is not None:
                chosen[s][rule] = cut
    return chosen


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def verdict(cutoffs: dict[str | None, dict[str, float]], stratum: str = "lang") -> Column:
    """True for documents that neither the base rules nor a cutoff of their stratum rejects."""
    bad = base_failed()
    for name, rules in cutoffs.items():
        for rule, cut in rules.items():
            bad = bad | (F.col(stratum).eqNullSafe(F.lit(name)) & (F.expr(RULES[rule]) > F.lit(cut)))
    return ~F.coalesce(bad, F.lit(True))


def joined_labels(narrow: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Measures with ``quality``, one row for each distinct text (``text_id``) of a stratum that has a label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    measured_ = [F.first(m).alias(m) for m in MEASURES]
    return narrow.join(known, "doc_id").filter(F.col("quality").isin(0, 1)).groupBy("text_id", stratum).agg(F.max("quality").alias("quality"), *measured_)


def with_text_id(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5(text).alias("text_id"), "text")


def judge_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed and kept."""
    narrow = materialise(measured(with_text_id(docs)).drop("text"), "quality")
    cutoffs = calibrate(joined_labels(narrow, labels), "lang", alpha, delta)
    return narrow.withColumns({"base_failed": base_failed(), "kept": verdict(cutoffs)})


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The documents that are kept, with their own columns, whatever their names."""
    plain = docs.toDF(*(f"c_{i}" for i in range(len(docs.columns))))
    place = {name: f"c_{i}" for i, name in enumerate(docs.columns)}
    # measured and written once, as texts are too long to be shuffled to their labels
    rows = materialise(measured(plain, place["text"]), "quality")
    text = F.coalesce(F.col(place["text"]), F.lit("")).cast("binary")
    narrow = rows.select(F.col(place["doc_id"]).cast("long").alias("doc_id"), F.col(place["lang"]).alias("lang"), F.md5(text).alias("text_id"), *MEASURES)
    cutoffs = calibrate(joined_labels(narrow, labels), "lang", alpha, delta)
    kept = rows.filter(verdict(cutoffs, place["lang"]))
    return kept.select(*(F.col(f"c_{i}").alias(name) for i, name in enumerate(docs.columns)))
