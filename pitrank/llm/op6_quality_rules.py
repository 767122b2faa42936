"""Quality rules by weak supervision: rules vote or abstain, their accuracies are estimated without labels, and the
posterior probability of good quality decides. DataFrame functions only.

Each rule votes bad (-1), good (1) or abstains (0). Rows are counted by vote pattern; there are at most 3 ** rules
patterns, whatever the input, and expectation-maximisation of a two-class model with independent rules runs over these
counts. The estimate becomes a column: the sum of the log-odds of a row's votes. Nothing holds a rule to a range: it may
turn out to be wrong often, or to say nothing, and good votes of reliable rules outweigh a bad one of a poor rule.
Classes are named by how estimation starts: rules are right more often than not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.blocks import cut, written

_SPACE = r"[ \t\n\x0B\f\r]+"
_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"  #: the base rules
#: Frequent short words of English, French, German and Spanish prose.
_COMMON = "the of and to in is that it for was on as with by be this are or an at from le la les de des et un une du en que qui pour dans il est der die das und zu den von ist mit im ein eine dem auf el los las y del se con por para lo".split()


def _measured(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """row (struct of the columns in ``carry``) and the measures of each text; null counts as empty."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    d = d.select(
        "row",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("lines"),
        (F.length("text") - left("[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        left("[^A-Z]+").alias("n_upper"),
        (F.length("text") - left("[!]+")).alias("n_shouts"),
        (F.length("text") - left(r"\p{L}+")).alias("n_letters"),
    )
    d = d.select(
        "row", "n_symbols", "n_upper", "n_shouts", "n_letters",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.filter("words", lambda w: w.isin(_COMMON))).alias("n_common"),
        F.size(F.filter("words", lambda w: w.endswith("."))).alias("n_ends"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, get(words, i + 1), get(words, i + 2)))").alias("runs"),
    )
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("runs")) < F.size("runs"), F.array_sort(F.transform("runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    again = "filter(sorted, (x, i) -> get(sorted, i - 1).h <=> x.h or get(sorted, i + 1).h <=> x.h)"
    d = d.withColumn("at", F.expr(f"array_sort(transform({again}, x -> x.i))")).drop("runs", "sorted")
    merged = "aggregate(at, named_struct('n', 0L, 'to', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.to), 'to', p), a -> a.n)"
    d = d.withColumn("n_repeat_words", F.coalesce(F.expr(merged), F.lit(0)).cast("long")).drop("at")
    # inline() keeps what follows from repeating these expressions: a filter would be pushed below and copy them
    return d.select("row", F.inline(F.array(F.struct(*[c for c in d.columns if c != "row"]))))


def _votes() -> dict[str, Column]:
    """What each rule says of a row's measures. Rules that see the same thing are one: the model takes them as independent."""
    c = F.expr
    vote = lambda bad, good: F.when(c(bad), -1).when(c(good), 1).otherwise(0)
    return {
        "symbols": vote("n_symbols > 0.1 * n_words", "n_symbols <= 0.01 * n_words"),
        "loud": vote("n_upper > 0.3 * word_chars or n_shouts > 0.1 * n_words", "n_upper <= 0.1 * word_chars and n_shouts <= 0.01 * n_words"),
        "repeats": vote("n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
        "lines": vote("n_lines > 3 and n_dup_lines > 0.5 * n_lines", "n_lines > 3 and n_dup_lines = 0"),
        "lengths": vote("word_chars > 12 * n_words or word_chars < 3 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
        "letters": vote("n_letters < 0.85 * word_chars", "n_letters >= 0.93 * word_chars"),
        "common": vote("n_common < 0.04 * n_words", "n_common >= 0.1 * n_words"),
        "ends": vote("n_ends < 0.01 * n_words or n_ends > 0.5 * n_words", "n_ends between 0.03 * n_words and 0.3 * n_words"),
    }


Patterns = list[tuple[tuple[int, ...], int]]


def estimated(patterns: Patterns, rules: int, rounds: int = 200, prior: float = 0.8, right: float = 0.9, smooth: float = 1.0) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of good before any vote, and each rule's log-odds by vote; to abstain says nothing.

    Starts from a share ``prior`` of good rows and rules that are right with probability ``right``. ``smooth`` votes
    of each kind are added to what is counted, so that no estimate is 0 or 1."""
    rate = {good: [{-1: 1 - right if good else right, 1: right if good else 1 - right} for _ in range(rules)] for good in (True, False)}
    weigh = lambda k, v: math.log(rate[True][k][v] / rate[False][k][v]) if v else 0.0
    for _ in range(rounds if patterns else 0):
        odds = [{v: weigh(k, v) for v in (-1, 0, 1)} for k in range(rules)]
        start, before = math.log(prior / (1 - prior)), (prior, rate)
        mass = {True: smooth, False: smooth}
        sums = {good: [{-1: smooth, 1: smooth} for _ in range(rules)] for good in mass}
        for votes, n in patterns:
            total = start + sum(o[v] for o, v in zip(odds, votes, strict=True))
            share = 1 / (1 + math.exp(-max(-500.0, min(500.0, total))))
            for good, part in ((True, share * n), (False, (1 - share) * n)):
                mass[good] += part
                for k, v in enumerate(votes):
                    if v:
                        sums[good][k][v] += part
        prior = mass[True] / (mass[True] + mass[False])
        rate = {good: [{v: x / sum(s.values()) for v, x in s.items()} for s in sums[good]] for good in sums}
        moved = abs(prior - before[0]) + sum(abs(rate[g][k][1] - before[1][g][k][1]) for g in rate for k in range(rules))
        if moved < 1e-9:
            break
    return math.log(prior / (1 - prior)), [{v: weigh(k, v) for v in (-1, 0, 1)} for k in range(rules)]


def _judged(measured: DataFrame, votes: dict[str, Column], prior: float, odds: list[dict[int, float]]) -> DataFrame:
    """Adds base_failed, posterior and kept."""
    total = F.lit(prior)
    for vote, of in zip(votes.values(), odds, strict=True):
        total = total + F.when(vote < 0, of[-1]).when(vote > 0, of[1]).otherwise(of[0])
    d = measured.withColumn("base_failed", F.expr(_FAILED))
    d = d.withColumn("posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def _learned(measured: DataFrame) -> tuple[dict[str, Column], float, list[dict[int, float]]]:
    votes = _votes()
    counts = measured.filter(~F.expr(_FAILED)).groupBy(*[v.alias(k) for k, v in votes.items()]).count().collect()
    return votes, *estimated(sorted((tuple(r[k] for k in votes), r["count"]) for r in counts), len(votes))


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior and kept.

    Null and empty texts have no words and fail the base rules (fewer than 50 words, or over half of the words in
    three-word runs that occur twice). Repeated rows and null ids are judged like others; accuracies are estimated
    over all rows that pass the base rules. Very long texts are measured whole: runs of three words are found again by sorting
    their hashes within the text. Measures are written to the checkpoint folder, texts are not."""
    measured = cut(_measured(docs, text, [doc_id]))
    out = _judged(measured, *_learned(measured))
    return out.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that quality_report keeps, with all their columns, of any name.

    Rows and their measures are written to the checkpoint folder once, so that texts are measured in one pass."""
    measured = written(_measured(docs, text, docs.columns))
    out = _judged(measured, *_learned(measured))
    return out.filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("posterior")
