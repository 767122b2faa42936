"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Base patterns find emails, addresses, cards and phone numbers. Every pattern takes a time linear in the text: groups
   are possessive, and a run of characters is entered at its first one only. A match's place is a running sum of the
   lengths of what lies between matches and of matches before it.
2. A number group, or a word with a digit or @, is an instance. Its lexical patterns are the two words before it, and
   the words on both sides of it. Instances that overlap a base span are seeds of its kind. A fifth kind, secret, is
   seeded by a quarter of the long hexadecimal strings, chosen by a hash; the other ones are unsure: they count neither
   for nor against a pattern, until a trusted one finds them.
3. Patterns and instances form a bipartite graph of distinct edges. In each round a pattern's score for a kind is the mean
   belief of its instances, those without any counting 0 (but for unsure ones). Patterns of enough believed instances and score are trusted; an
   unlabelled instance believes the best trusted pattern it occurs with. So instances discovered in one round induce the
   patterns of the next. Seeds keep belief 1.
4. An occurrence of an unlabelled instance in a pattern that is trusted at the end becomes a span of the pattern's kind.
   So does one of a secret's seed in a pattern of secrets; elsewhere a long hexadecimal string (a checksum) is no span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitrank.llm.blocks import cut

KINDS = ("email", "ip", "card", "phone", "secret")
_W = r" \t\n\x0B\f\r"
#: The base patterns. Possessive groups match what greedy ones do, as nothing after them needs a step back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NUMBER = rf"[(+]*+[0-9][0-9()./+-]*+(?![^{_W},;:!?\"'])"
INSTANCE = rf"(?<![^{_W}])(?:{_NUMBER}(?: {_NUMBER})*+|[^{_W}0-9@]*+[0-9@][^{_W}]*+)"
SECRET = r"^(?=[0-9]*+[a-fA-F])[0-9a-fA-F]{32,}$"
SEEDED = 4  #: one of so many strings of that form is a seed
EDGES = "\"'`()[]{}<>.,;:!?*#$%&|="  #: punctuation that an instance doesn't begin or end with
_HINT = {"email": "@", "phone": "+"}
_UNIT = 1_000_000  #: beliefs and scores are whole parts of this, so that sums don't depend on their order


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _matches(number: int, pattern: str, hint: str, context: bool) -> str:
    """SQL: array of (k, i, skip, value, before, after) of all matches; skip is the length of what lies before."""
    p = _sql(pattern)
    before = "case when i > 0 then concat('# ', g) else g end" if context else "cast(null as string)"
    after = "get(gaps, i + 1)" if context else "cast(null as string)"
    one = f"named_struct('k', {number}, 'i', i, 'skip', length(g), 'value', get(found, i), 'before', {before}, 'after', {after})"
    body = f"transform(slice(gaps, 1, size(found)), (g, i) -> {one})"
    both = f"transform(array(named_struct('gaps', split(text, '{p}'), 'found', regexp_extract_all(text, '{p}', 0))), b -> {body.replace('gaps', 'b.gaps').replace('found', 'b.found')})"
    empty = "cast(array() as array<struct<k: int, i: int, skip: int, value: string, before: string, after: string>>)"
    return f"case when {hint} then flatten({both}) else {empty} end"


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes Luhn's check."""
    value = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (s, i) -> s + case when i % 2 = 0 then {value} when {value} > 4 then 2 * {value} - 9 else 2 * {value} end) % 10 = 0"


def _valid() -> Column:
    """Whether a match of a base pattern counts."""
    ip = "forall(split(value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)"
    card = f"case when length(digits) between 12 and 19 then {_luhn('digits')} else false end"
    return F.expr(f"case k when 1 then {ip} when 2 then {card} when 3 then length(digits) between 9 and 15 else true end")


def _side(text: str) -> str:
    """SQL: lower-case words of a context, one blank between two."""
    return f"trim(regexp_replace(lower({text}), '[{_sql(_W)}]+', ' '))"


def _placed(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid base spans (row, start, k, end), and instances (row, start, end, v, value, one, two)."""
    each = d.select("row", F.explode("matches").alias("m")).select("row", "m.*")
    so_far = Window.partitionBy("row", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.expr("skip + length(value)")).over(so_far).cast("int")).withColumn("start", F.expr("end - length(value)"))
    base = each.filter("k < 4").withColumn("digits", F.expr("regexp_replace(value, '[^0-9]', '')")).filter(_valid()).select("row", "start", "k", "end")
    edges = EDGES.replace("'", "\\'")
    inner = each.filter("k = 4").withColumn("left", F.expr(f"ltrim('{edges}', value)")).withColumn("core", F.expr(f"rtrim('{edges}', left)"))
    inner = inner.withColumn("start", F.expr("start + length(value) - length(left)")).withColumn("end", F.expr("start + length(core)")).filter("core <> ''")
    inner = inner.withColumn("b", F.expr(_side("before"))).withColumn("a", F.expr(_side("after")))
    two = "case when contains(b, ' ') then concat('L ', substring_index(b, ' ', -2)) end"
    one = "case when b <> '' then concat('M ', substring_index(b, ' ', -1), ' _ ', case when a <> '' then substring_index(a, ' ', 1) else '#' end) end"
    return base, inner.select("row", "start", "end", F.xxhash64("core").alias("v"), F.col("core").alias("value"), F.xxhash64(F.expr(two)).alias("two"), F.xxhash64(F.expr(one)).alias("one"), F.expr(f"{two} is not null").alias("has_two"), F.expr(f"{one} is not null").alias("has_one"))


def _labelled(base: DataFrame, inner: DataFrame) -> DataFrame:
    """Instances with ``seed`` (the kind of the base span they overlap, or 4 for a secret), ``over`` (whether they overlap
    one) and ``unsure`` (of a secret's form, but no seed)."""
    none = lambda kind: F.lit(None).cast(kind)
    names = ["row", "start", "end", "k", "v", "value", "two", "one", "has_two", "has_one"]
    both = base.select("row", "start", "end", "k", none("long").alias("v"), none("string").alias("value"), none("long").alias("two"), none("long").alias("one"), none("boolean").alias("has_two"), none("boolean").alias("has_one"))
    both = both.unionByName(inner.withColumn("k", none("int")).select(names))
    # two growing frames, as a frame that ends with the partition is computed anew for every row
    upto, onwards = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc("start"), F.desc("start")))
    both = both.withColumn("prev", F.max(F.when(F.col("k").isNotNull(), F.struct("end", "k"))).over(upto)).withColumn("next", F.min(F.when(F.col("k").isNotNull(), F.struct("start", "k"))).over(onwards))
    met = F.expr("case when prev.end > start then prev.k when next.start < end then next.k end")
    out = both.filter("k is null").withColumn("met", met)
    form, drawn = F.col("value").rlike(SECRET), F.expr(f"crc32(value) % {SEEDED} = 0")
    return out.select("row", "start", "end", "v", "two", "one", "has_two", "has_one", F.col("met").isNotNull().alias("over"), F.coalesce("met", F.when(form & drawn, F.lit(4))).alias("seed"), (form & ~drawn).alias("unsure"))


def _trusted(seen: DataFrame, rounds: int, support: int, confidence: float) -> DataFrame:
    """Patterns trusted after the last round: p, k and score."""
    pairs = seen.select("v", "unsure", F.explode(F.expr("filter(array(case when has_two then two end, case when has_one then one end), x -> x is not null)")).alias("p")).distinct()
    known = seen.filter("seed is not null").groupBy("v").agg(F.min("seed").alias("seed"))
    edges = cut(pairs.join(known, "v", "left").withColumn("unsure", F.col("unsure") & F.col("seed").isNull()))
    size = edges.groupBy("p").agg(F.count_if(~F.col("unsure")).alias("n"))
    seeds = known.select("v", F.col("seed").alias("k"), F.lit(_UNIT).cast("long").alias("b"))
    belief, good = seeds, None
    for r in range(rounds):
        mass = edges.select("p", "v", "unsure").join(belief, "v").groupBy("p", "k").agg(F.sum("b").alias("b"), F.count("*").alias("s"), F.count_if("unsure").alias("u"))
        good = mass.join(size, "p").withColumn("score", F.expr("b div (n + u)")).filter((F.col("score") >= round(confidence * _UNIT)) & (F.col("s") >= support))
        good = cut(good.select("p", "k", "score"))
        if r + 1 < rounds:
            best = edges.filter("seed is null").select("p", "v").join(good, "p").groupBy("v").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("x"))
            belief = cut(seeds.union(best.select("v", (-F.col("x.k")).alias("k"), F.col("x.score").alias("b"))))
    return good


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 3, confidence: float = 0.8) -> DataFrame:
    """Per row: doc_id, base (array of (start, order, end, kind) of the base patterns, by start and kind) and found
    (the same for discovered spans, secrets among them). Offsets are code points, the end is exclusive.

    Null and empty texts have no spans. Rows that repeat (id and text) get the same spans, a null id is like any other.
    ``support`` is the number of distinct believed instances a pattern needs, ``confidence`` the score (above 0.5).
    Texts are read once and never shuffled; matches and the words around instances leave the scan. Whatever a text
    holds (a megabyte of digits, dots or addresses), the work is linear in its length, but for the sorting of its
    matches, which one task does. Other columns, of any name, are not read."""
    if not 0.5 < confidence <= 1:
        raise ValueError("confidence must be above 0.5, so that a pattern has one kind")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    arrays = [_matches(i, p, f"contains(text, '{_HINT[k]}')" if k in _HINT else "text rlike '[0-9]'", False) for i, (k, p) in enumerate(BASE.items())]
    arrays.append(_matches(4, INSTANCE, "text rlike '[0-9@]'", True))
    d = cut(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*map(F.expr, arrays)).alias("matches")))
    base, inner = _placed(d)
    base = cut(base)
    seen = cut(_labelled(base, inner))
    good = _trusted(seen, rounds, support, confidence)

    hits = [seen.filter(f"(seed is null or (seed = 4 and not over)) and has_{w}").select("row", "start", "end", "seed", F.col(w).alias("p")).join(good, "p").filter("seed is null or k = 4").select("row", "start", "end", "k", "score") for w in ("two", "one")]
    hits = hits[0].union(hits[1]).groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("x")).select("row", "start", (-F.col("x.k")).alias("k"), "end")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k") + 1)
    all_ = base.withColumn("b", F.lit(True)).unionByName(hits.withColumn("b", F.lit(False)))
    span = F.struct("start", F.col("k").alias("o"), "end", name.alias("kind"))
    spans = all_.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("b"), span))).alias("base"), F.array_sort(F.collect_list(F.when(~F.col("b"), span))).alias("found"))
    none = F.expr("cast(array() as array<struct<start: int, o: int, end: int, kind: string>>)")
    return d.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns, all spans, and n_found, the number of spans that the method adds."""
    d = pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    return d.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("array_sort(concat(base, found))").alias("spans"), F.size("found").cast("long").alias("n_found"))
