"""Quality rules with risk-controlled cutoffs, all in DataFrame functions.

Fixed rules fail a document outright. Beyond them, a document is rejected if a signal (symbols, capitals, repeated lines,
words repeated at once) exceeds its stratum's cutoff. Cutoffs come from labelled holdouts: a cutoff is admitted only if the exact
binomial tail says that it rejects at most ``RISK`` of the good documents of the stratum, at level ``LEVEL`` shared among all
strata, signals and cutoffs tried (Bonferroni). Of the admitted ones that catch nearly as many bad documents as any, the
one with the fewest good documents rejected is taken, the largest in a tie. Without an admitted cutoff a signal rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import free_names, stored

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SIGNALS = ("symbols", "capitals", "dup_lines", "runs")
CUTOFFS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
#: False rejection of good documents admitted for a signal in a stratum, and the chance that any admitted cutoff breaks it.
RISK = 0.005
LEVEL = 0.05
#: Share of the best admitted cutoff's catch that the chosen one keeps.
NEARLY = 0.98


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), use)[0]


def _covered(h: Column) -> Column:
    """Words in windows whose hash occurs more than once; ``h`` has the hash of the window at each position."""
    ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twins = lambda s: F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(_let(ranked, twins), lambda p: p.isNotNull()))))
    steps = lambda p: F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(_let(at, steps), F.lit(0).cast("long"), lambda s, x: s + x)


def with_signals(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and that column's name: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), the share of each signal (double) and base_failed (boolean)."""
    text, words, lines, h, runs, name = free_names(docs, "q_text", "q_words", "q_lines", "q_hash", "q_runs", "quality")
    keep = docs.columns
    df = docs.select("*", F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    df = df.select("*", F.filter(F.split(text, BLANK), lambda w: w != "").alias(words), F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias(lines))
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))
    same = F.zip_with(h, F.slice(h, 2, F.size(h)), lambda a, b: (a == b).cast("int"))
    df = df.withColumn(runs, F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))))
    for step in (2, 3, 5):  # after these, the hash at a position is of 2, 4, 8 words
        df = df.withColumn(h, F.zip_with(h, F.slice(h, step, F.size(h)), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(h, F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))))
    count = lambda pattern: (F.size(F.split(text, pattern)) - 1).cast("long")
    some = F.size(F.array_distinct(h)) < F.size(h)
    df = df.select(
        *(F.col(f"`{c}`") for c in keep),
        F.size(words).cast("long").alias(words),
        F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias(text),
        F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), count("[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_capitals"),
            F.when(some, _covered(F.col(h))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"), F.col(runs).alias("n_runs"),
        ).alias(lines),
    )
    n, chars, q = F.col(words), F.col(text), F.col(lines)
    share = lambda x, of: x / F.greatest(of, F.lit(1))
    return df.select(
        *(F.col(f"`{c}`") for c in keep),
        F.struct(
            n.alias("n_words"), chars.alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"), q["n_repeat_words"].alias("n_repeat_words"),
            share(q["n_symbols"], chars).alias("symbols"), share(q["n_capitals"], chars).alias("capitals"), share(q["n_dup_lines"], q["n_lines"]).alias("dup_lines"), share(q["n_runs"], n).alias("runs"),
            ((n < MIN_WORDS) | (q["n_repeat_words"] * 100 > n * MAX_REPEAT_PERCENT)).alias("base_failed"),
        ).alias(name),
    ), name


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) for X of ``n`` trials at ``risk``, by summing exact terms."""
    first = F.struct((n * F.log1p(F.lit(-risk))).alias("term"), F.lit(0.0).alias("sum"))
    odds = F.log(F.lit(risk / (1 - risk)))
    step = lambda s, j: F.struct((s["term"] + F.log((n - j) / (j + 1)) + odds).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, step, lambda s: s["sum"])


def cutoffs(signals: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, name: str) -> DataFrame:
    """(stratum, one cutoff or null a signal): see the module's text. A document labelled both ways counts as good."""
    own = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("q_id")).agg((F.max("quality") > 0).alias("good"))
    held = signals.select(F.col(f"`{id_col}`").alias("q_id"), F.coalesce(F.col(f"`{stratum_col}`"), F.lit("und")).alias("stratum"), F.col(name).alias("q")).where("not q.base_failed").join(own, "q_id")
    over = [F.count_if(F.col("good") == good).alias(f"n{int(good)}") for good in (True, False)]
    over += [F.count_if((F.col("good") == good) & (F.col("q")[s] > c)).alias(f"k{int(good)}_{s}_{i}") for good in (True, False) for s in SIGNALS for i, c in enumerate(CUTOFFS)]
    counts = held.groupBy("stratum").agg(*over)
    tried = F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"k1_{s}_{i}").alias("k"), F.col(f"k0_{s}_{i}").alias("caught")) for s in SIGNALS for i, c in enumerate(CUTOFFS)))
    rows = stored(counts.select("stratum", F.col("n1").alias("n"), F.explode(tried).alias("t")).select("stratum", "n", "t.*"), "cutoffs")
    level = LEVEL / max(1, rows.count())
    admitted = rows.where((F.col("k") < F.col("n") * RISK) & (binomial_tail(F.col("k"), F.col("n"), RISK) <= level))
    most = admitted.groupBy("stratum", "signal").agg(F.max("caught").alias("most"))
    near = admitted.join(most, ["stratum", "signal"]).where((F.col("caught") >= F.col("most") * NEARLY) & (F.col("most") > 0))
    best = near.groupBy("stratum", "signal").agg(F.min(F.struct("k", (-F.col("cutoff")).alias("c")))["c"].alias("c"))
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("signal") == s, -F.col("c"))).alias(s) for s in SIGNALS))


def judged(signals: DataFrame, labels: DataFrame, name: str, id_col: str = "doc_id", stratum_col: str = "lang") -> tuple[DataFrame, str]:
    """``signals`` with one column more, and its name: false if a fixed rule or a stratum's cutoff rejects the row.

    ``labels``: doc_id, quality. Strata are the values of ``stratum_col``, null as ``und``; where labels are too few nothing is
    rejected beyond the fixed rules. Null and empty texts have no words and fail them. Repeated rows are judged alike.
    """
    stratum, cutoff, kept = free_names(signals, "q_stratum", "q_limits", "q_kept")
    limits = cutoffs(signals, labels, id_col, stratum_col, name)
    limits = stored(limits.select(F.col("stratum").alias(stratum), F.struct(*SIGNALS).alias(cutoff)), "limits")
    df = signals.join(limits, F.coalesce(F.col(f"`{stratum_col}`"), F.lit("und")) == F.col(stratum), "left")
    breach = F.col(f"{name}.base_failed")
    for s in SIGNALS:
        breach = breach | F.coalesce(F.col(f"{name}.{s}") > F.col(cutoff)[s], F.lit(False))
    return df.select(*(F.col(f"`{c}`") for c in signals.columns), (~breach).alias(kept)), kept


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, a row for each of ``docs`` (doc_id, text, lang; others aren't read)."""
    signals, name = with_signals(docs.select("doc_id", "text", "lang"))
    signals = stored(signals.drop("text"), "signals")
    fields = [F.col(f"{name}.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    out, kept = judged(signals, labels, name)
    return out.select("doc_id", *fields, F.col(kept).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    signals, name = with_signals(docs)
    out, kept = judged(stored(signals, "signals"), labels, name)
    return out.where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
