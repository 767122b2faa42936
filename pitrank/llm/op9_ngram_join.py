"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Documents with equal shingle sets become one class (grouped by a 128-bit hash of the set).
2. The document frequency of every shingle over the classes is counted through the block exchange.
3. Each class orders its shingles rarest first. Two sets with Jaccard t share a shingle among the first
   n - ceil(t n) + 1 of each, and the shorter one has it among its first n - ceil(2t/(1+t) n) + 1. Shingles of one class
   only have no partner, so they are never posted: text of its own posts nothing.
4. Classes that share a posted shingle are paired under the length and positional filters: first each with the
   smallest class of its list (a star), then, as only components are asked for, only those whose components still
   differ. A large group of near copies therefore costs about a row per copy, not one per pair of copies.
5. Each pair is verified once: the suffix filter bounds the overlap by parts of the hash range, then sets intersect.
   The set of a class with many partners, a hub, travels once for each ``PARTNERS`` of them.

Order and prefix hold whatever the frequencies are, so a collision of the 32-bit keys used for counting can't change
the result. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitrank.llm.blocks import answered, blocked, by_bucket, cut, map_batches, n_blocks, unpacked
from pitrank.llm.components import components
from pitrank.llm.words import members, mix, shingle_sets, table

_BYTES = table(lower=True)
_NO_ID = 2**63 - 1
BROADCAST_IDS = 1 << 20  #: ids of removed documents that are broadcast; more are joined by a shuffle
PARTNERS = 32  #: partners (expected) that one copy of a hub's set is compared with
HOT, SALTS = 200, 64  #: a class with more than 1 / HOT of all rows is named in SALTS parts
_CUTS = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("many", pa.binary()), ("many_n", pa.binary())])
_COUNTED = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("df", pa.binary())])
_POSTED = pa.schema([("token", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("pos", pa.int32()), ("shingles", pa.binary())])


def _classes(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    """doc_id, block, n_shingles and the set's hash; two sums over distinct shingles."""
    sets, edge = shingle_sets(batch["text"], _BYTES, n)
    sums = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(salt)))])
        sums.append(total[edge[1:]] - total[edge[:-1]])
    both = np.stack(sums, 1).tobytes()
    keys = [both[16 * i : 16 * i + 16] for i in range(batch.num_rows)]
    return pa.RecordBatch.from_arrays([batch["doc_id"], batch["block"], pa.array(np.diff(edge)), pa.array(keys, pa.binary())], ["doc_id", "block", "n_shingles", "c"])


def _representatives(docs: pa.Table, reps: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sets of a block's representatives: values, edges and nodes. A class is represented by one row."""
    nodes = {node[8:]: node for node in reps["node"].to_pylist()}
    if not nodes or not docs.num_rows:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), []
    keys = _classes(docs.combine_chunks().to_batches()[0], n)["c"].to_pylist()
    rows, of = [], []
    for i, key in enumerate(keys):
        if (node := nodes.pop(key, None)) is not None:
            rows.append(i)
            of.append(node)
    sets, edge = shingle_sets(docs["text"].combine_chunks().take(pa.array(rows, pa.int64())), _BYTES, n)
    return sets, edge, of


def _send(docs: pa.Table, reps: pa.Table, n: int, buckets: int) -> pa.Table:
    """A block's distinct shingles and in how many of its classes each is."""
    sets, _, _ = _representatives(docs, reps, n)
    if not len(sets):
        return _SENT.empty_table()
    found, count = np.unique(sets, return_counts=True)
    short = (found // np.uint64(buckets)).astype(np.uint32)
    one, more = count == 1, count > 1
    block = reps["block"][0].as_py()
    a = by_bucket(block, found[one], buckets, pa.schema(list(_SENT)[:3]), once=short[one])
    b = by_bucket(block, found[more], buckets, pa.schema([_SENT.field(i) for i in (0, 1, 3, 4)]), many=short[more], many_n=count[more].astype(np.uint32))
    return pa.concat_tables([a, b], promote_options="default").select(_SENT.names).cast(_SENT)


def _count(t: pa.Table) -> pa.Table:
    """For each block the bucket's shingles of two classes or more, with their number."""
    once, row1 = unpacked(t["once"], np.uint32)
    many, row2 = unpacked(t["many"], np.uint32)
    weight = np.concatenate([np.ones(len(once), np.uint32), unpacked(t["many_n"], np.uint32)[0]])
    key, row = np.concatenate([once, many]), np.concatenate([row1, row2])
    _, at = np.unique(key, return_inverse=True)
    df = np.bincount(at, weight)[at].astype(np.uint32) if len(key) else weight
    order = np.argsort(row, kind="stable")
    return answered(t, (df > 1)[order], row[order], _COUNTED, found=key[order], df=df[order])


def _post(docs: pa.Table, side: pa.Table, n: int, buckets: int, percent: int) -> pa.Table:
    """Postings of a block's classes, and one row with the whole set for each class that has any."""
    reps = side.filter(pc.is_valid(side["node"]))
    told = side.filter(pc.is_null(side["node"]))
    sets, edge, nodes = _representatives(docs, reps, n)
    if not nodes or not told.num_rows:
        return _POSTED.empty_table()
    short, row = unpacked(told["found"], np.uint32)
    df_of = unpacked(told["df"], np.uint32)[0]
    key = (told["bucket"].to_numpy()[row].astype(np.uint64) << np.uint64(32)) | short
    order = np.argsort(key)
    key, df_of = key[order], df_of[order]
    own = ((sets % np.uint64(buckets)) << np.uint64(32)) | (sets // np.uint64(buckets)).astype(np.uint32).astype(np.uint64)
    df = np.ones(len(own), np.uint32)
    hit = members(own, key)
    df[hit] = df_of[np.searchsorted(key, own[hit])]
    tokens, owner, pos, size, blobs = [], [], [], [], []
    for i, node in enumerate(nodes):
        a, b = edge[i], edge[i + 1]
        m = b - a
        prefix = m - -(-percent * m // 100) + 1
        alone = int((df[a:b] == 1).sum())
        if alone >= prefix:
            continue
        first = np.lexsort((sets[a:b], df[a:b]))[alone:prefix]
        tokens += [np.append(sets[a:b][first].view(np.int64), 0)]
        pos += [np.append(np.arange(alone, prefix), -1)]
        size += [np.full(len(first) + 1, m)]
        owner += [node] * (len(first) + 1)
        blobs += [None] * len(first) + [sets[a:b].tobytes()]
    if not owner:
        return _POSTED.empty_table()
    return pa.table([pa.array(np.concatenate(tokens)), pa.array(owner, pa.binary()), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(blobs, pa.binary())], schema=_POSTED)


def _linked(batch: pa.RecordBatch, percent: int) -> pa.Table:
    """The batch's pairs that reach the threshold. A row holds a set, and partners with theirs."""
    left, right = [], []
    counts = lambda s: np.diff(np.searchsorted(s, _CUTS), prepend=0, append=len(s))
    for row in range(batch.num_rows):  # one row at a time, as sets may be long
        node, a = batch["a"][row].as_py(), np.frombuffer(batch["sa"][row].as_buffer(), np.uint64)
        part = counts(a)
        for other in batch["others"][row].as_py():
            b = np.frombuffer(other["sb"], np.uint64)
            need = -(-percent * (len(a) + len(b)) // (100 + percent))
            both = int(members(a, b).sum()) if np.minimum(part, counts(b)).sum() >= need else 0
            if 100 * both >= percent * (len(a) + len(b) - both):
                left.append(node)
                right.append(other["b"])
    return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among distinct pairs (a, b). b's set joins its pairs, which are then packed into rows of about
    ``PARTNERS`` for each a; so a hub's set and its key appear in few rows, and no row grows with the hub."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > PARTNERS).select("a", F.expr(f"n div {PARTNERS} + 1").alias("parts"))
    p = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(many, "a", "left")
    p = p.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))))
    p = p.groupBy("a", "part").agg(F.collect_list(F.struct("b", "sb")).alias("others"))
    p = p.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return map_batches(p.select("a", "sa", "others"), lambda t: _linked(t, percent), "a binary, b binary")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Length and positional filters: what is left from the shared shingle on must reach the overlap needed."""
    c = F.expr
    need = c(f"ceil({percent} * ({x}.n + {y}.n) / {100 + percent})")
    length = c(f"least({x}.n, {y}.n) * 100 >= {percent} * greatest({x}.n, {y}.n)")
    return length & (F.least(c(f"{x}.n - {x}.pos"), c(f"{y}.n - {y}.pos")) >= need)


_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{x.name} {_SQL[x.type]}" for x in schema)


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their distinct n-word shingles (A-Z folded, white
    space separates); one with fewer words is a single shingle. Null or empty texts have no shingle and link with
    nothing: they are their own component. Rows that repeat a doc_id are linked like others, by their texts. A null
    doc_id never names a component unless all of the component's are null. Very long texts have all
    their shingles compared. Other columns, of any name, are not read."""
    blocks = n_blocks(docs, text)
    base = blocked(docs, doc_id, text, blocks)
    rows = cut(map_batches(base, lambda b: _classes(b, n), "doc_id long, block int, n_shingles long, c binary"))
    key = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("rep"), "block")
    sign = F.unhex(F.lpad(F.hex(F.col("k.rep").bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    grouped = cut(rows.filter("n_shingles > 0").groupBy("c").agg(F.min(key).alias("k"), F.count("*").alias("copies")))
    hot = [r.c for r in grouped.filter(F.col("copies") * HOT > rows.count()).select("c").collect()]  # fewer than HOT
    classes = grouped.select("c", F.concat(sign, "c").alias("node"), "k.rep", "k.block")
    reps = classes.select("block", "node")

    def send(docs: pa.Table, reps: pa.Table) -> pa.Table:
        return _send(docs, reps, n, blocks)

    def post(docs: pa.Table, side: pa.Table) -> pa.Table:
        return _post(docs, side, n, blocks, percent)

    sent = base.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(send, _ddl(_SENT))
    told = sent.groupBy("bucket").applyInArrow(_count, _ddl(_COUNTED))
    side = reps.select("block", "node", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("found"), F.lit(None).cast("binary").alias("df")).unionByName(told, allowMissingColumns=True)
    posted = cut(base.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(post, _ddl(_POSTED)))
    sets, postings = posted.filter("pos < 0").select("node", "shingles"), posted.filter("pos >= 0").select("token", "node", "n", "pos")

    heads = postings.groupBy("token").agg(F.min(F.struct("node", "n", "pos")).alias("x"), F.count("*").alias("k")).filter("k > 1")
    star = heads.join(postings.select("token", F.struct("node", "n", "pos").alias("y")), "token").filter("x.node != y.node").filter(_may_link("x", "y", percent))
    tried = cut(star.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    links = cut(_verified(tried, sets, percent))
    found = cut(components(links))

    at = postings.join(found, "node", "left").withColumn("of", F.coalesce("component", "node"))
    open_ = at.groupBy("token").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).filter("lo < hi").select("token")
    at = at.join(open_, "token", "left_semi").select("token", F.struct("node", "n", "pos", "of").alias("x"))
    first = at.filter(F.expr(f"x.pos <= x.n - ceil({2 * percent} * x.n / {100 + percent})"))
    second = at.select("token", F.col("x").alias("y"))
    pairs = first.join(second, "token").filter("x.of != y.of and x.n <= y.n").filter(_may_link("x", "y", percent))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    more = _verified(cut(pairs.join(tried, ["a", "b"], "left_anti")), sets, percent)
    found = components(links.union(more))
    named = classes.join(found, "node", "left").withColumn("of", F.coalesce("component", "node"))
    digits = F.conv(F.hex(F.substring("of", 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")
    named = named.select("c", digits.cast("long").alias("of"))
    if hot:
        often = F.col("c").isin(hot)
        rows = rows.withColumn("s", F.when(often, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0))
        named = named.withColumn("s", F.explode(F.when(often, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    out = rows.join(named, ["c", "s"] if hot else "c", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("of") == _NO_ID, F.lit(None)).otherwise(F.coalesce("of", "doc_id")).cast("long").alias("component_id"))


def keep_smallest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` with one document of each component left: that with the smallest doc_id.

    Rows that repeat a doc_id count as one document and one of them is left. Rows with a null doc_id, which can't be
    told apart, all stay. Columns of any name pass through."""
    linked = cut(ngram_join(docs, doc_id, text, n, percent))
    gone = cut(linked.filter("component_id < doc_id").select(F.col("doc_id").alias(doc_id)).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(side, doc_id, "left_anti").select(docs.columns)
    more = linked.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(doc_id))
    if more.isEmpty():
        return left
    more = cut(more)
    once = left.join(more, doc_id, "left_anti").select(docs.columns)
    return once.union(left.join(more, doc_id, "left_semi").select(docs.columns).dropDuplicates([doc_id]))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS v FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(v) < 5 THEN array_to_string(v, ' ') ELSE array_to_string(v[i : i + 4], ' ') END AS g
  FROM w, unnest(range(1, greatest(len(v) - 3, 2))) AS t(i) WHERE len(v) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
