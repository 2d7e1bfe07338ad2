"""Near-duplicate documents by min-max hashing, banding, full-set verification and connected components.

A document's set holds its distinct shingles of five words (the whole sequence if it has fewer). Each of ``PERMS``
permutations of the 64-bit shingle hashes gives two signature values, the least and the greatest image, so 64 hash
evaluations make 128 values. They are banded four by four, each value of a band from another permutation, which keeps
the collisions of a band independent: at the threshold of 0.75 a link is missed with (1 - 0.75^4)^32 = 5e-6.

Steps, none of which emits all pairs of a group:

1. Rows with equal sets are one set, by two combined sums of its hashes. All that follows goes by the set and not by an
   id, which two texts may share.
2. Sets most of whose minima no other set has are put aside: they can have no near copy. In each bucket of the rest
   every set is paired with the bucket's least set only. Pairs whose signatures agree enough are held against the full
   sets, and the links found form the first components.
3. Buckets that still hold several components have links to lose. Their sets are first held against another member of
   the component that has most of a bucket: what joins it need not be paired with each of its members. An overlap of two components has only shingles that
   two components hold, so sets with too few of these drop out, which is exact. Of the others, pairs with a rare shingle
   in common meet by their rarest ones, as many as an overlap cannot do without one of. Pairs without one can be links
   only if common shingles alone make up enough of both; what then remains meets in its buckets, members of different
   components only, and a bucket of any size is treated alike: large ones are dealt over salts.
4. Components are joined by alternating large and small stars, each round written to the shared folder.

What chance can lose: a link at the threshold that meets in no bucket (5e-6), in a signature with too few agreeing
values (5e-9) or with a set put aside (1e-8); all three fall with the similarity. ``tests/llm`` measures the recall.

Cases: documents without words (null, empty, blank) have an empty set, are linked with nothing and are their own
component; repeated rows are equal sets and share a class; rows of a null id are classed by their text but never name
a class while an id is there (alone they have a null component, and are kept); of rows that share an id but not a text
each is classed by its own text; an empty table gives an empty result; further columns are ignored. ``distinct_documents``
leaves one row of each class, the one of the least id and then of the least hash of its text, and of repeated rows any
one; rows without words are no copies of each other, but rows that repeat an id and a text are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import light_batches, passing, small, table, written

WIDTH, PERCENT = 5, 75
PERMS, ROWS = 64, 4
BANDS = 2 * PERMS // ROWS
#: A pair goes to full verification if so many of its 2 * PERMS values agree: 5.8 standard deviations below 0.75.
AGREE = int(0.53 * 2 * PERMS)
#: A shingle is rare if at most so many of the sets in question have it.
RARE = 8
#: A bucket is dealt over salts of about so many sets each.
SALT = 256
#: A set has company if at least so many of its PERMS minima are others' too: 5.8 standard deviations below 0.75.
SHARED = int(0.44 * PERMS)
#: Rounds in which torn sets are held against other members of large components before all that is left is proved.
TURNS = 1
#: Word hashes kept by a worker.
CACHE = 200_000

_draw = np.random.default_rng(20_261)
_MULT = _draw.integers(1, 2**64, PERMS, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _draw.integers(0, 2**64, PERMS, np.uint64, endpoint=False)
_PLACE = _draw.integers(1, 2**64, WIDTH, np.uint64, endpoint=False) | np.uint64(1)
#: Row i: the values of band i. Even ones are minima, odd ones maxima; a band takes each from another permutation.
_BAND = np.array([[2 * (ROWS * (i % (BANDS // 2)) + j) + (i // (BANDS // 2) + j) % 2 for j in range(ROWS)] for i in range(BANDS)])


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - WIDTH + 1
    h = w[:n] * _PLACE[0]
    for k in range(1, WIDTH):
        h += w[k : n + k] * _PLACE[k]
    return np.unique(_mixed(h))


def signature(found: np.ndarray) -> np.ndarray:
    """Upper halves of minimum and maximum under each permutation, in turn."""
    low, high = np.full(PERMS, 2**64 - 1, np.uint64), np.zeros(PERMS, np.uint64)
    for i in range(0, len(found), 4096):
        image = _MULT[:, None] * found[i : i + 4096] + _ADD[:, None]
        low, high = np.minimum(low, image.min(1)), np.maximum(high, image.max(1))
    return (np.stack([low, high], 1).ravel() >> np.uint64(32)).astype(np.uint32)


def bands(sign: np.ndarray) -> np.ndarray:
    x = sign.astype(np.uint64)[_BAND]
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mixed(h ^ x[:, k]) + np.uint64(k)
    return h.view(np.int64)


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for t in rows["text"]:
            s = shingles(t)
            if len(s):
                keys = [int(_mixed(s + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2)]
                sign = signature(s)
                out.append((len(s), *keys, sign.tobytes(), bands(sign)))
            else:
                out.append((0, None, None, None, None))
        more = pd.DataFrame(out, columns=["n_shingles", "k1", "k2", "sign", "bands"], index=rows.index)
        yield pd.concat([rows[["doc_id", "text_key"]], more.astype({"k1": "Int64", "k2": "Int64"})], axis=1)


def profiles(docs: DataFrame) -> DataFrame:
    """Size of the set, its identity in two sums of hashes, signature and band keys of each document."""
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInPandas(
        _profiles, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sign binary, bands array<long>")


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            a, b = (np.frombuffer(b"".join(rows[c]), np.uint32).reshape(len(rows), -1) for c in ("sign_a", "sign_b"))
            yield rows.loc[(a == b).sum(1) >= AGREE, ["a", "b"]]


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        sets: dict[int, np.ndarray] = {}
        ok = []
        for a, b, x, y in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
            s = shingles(x)
            if b not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[b] = shingles(y)
            t = sets[b]
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        yield rows.loc[ok, ["a", "b"]]


def _overlapping(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        ok = []
        for s, t in zip(rows["h_a"], rows["h_b"], strict=True):
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(s) + len(t) - both))
        yield rows.loc[ok, ["a", "b"]]


def texts_of(ids: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``(id, text)``: one text of each of the sets ``id``."""
    wanted = sets.select("id", F.col("rep.doc_id").alias("_doc"), F.col("rep.text_key").alias("_key")).join(ids, "id", "left_semi")
    wanted = small(written(wanted, "dedup-wanted"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    rows = rows.join(wanted, rows["_id"].eqNullSafe(wanted["_doc"]) & (F.xxhash64(rows["text"]) == wanted["_key"]))
    return rows.groupBy("id").agg(F.first("text").alias("text"))  # rows may repeat


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are links by their full sets, after their signatures have sieved them."""
    sa, sb = (sets.select(F.col("id").alias(c), F.col("sign").alias(f"sign_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in "ab")
    near = pairs.join(sa, "a").join(sb, "b").where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
    near = written(near.select("a", "b", "sign_a", "sign_b").mapInPandas(_agreeing, "a long, b long"), "dedup-near")
    texts = texts_of(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), sets, docs)
    ta, tb = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    # The side with one row per pair moves with its text first; the bucket leaders' texts meet it in the second join.
    both = near.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return written(both.mapInPandas(_linked, "a long, b long").distinct(), "dedup-links")


def components(links: DataFrame, name: str = "dedup-stars") -> DataFrame:
    """``(id, component)`` of every id in the links, the component being the least id reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    state = None
    while True:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == row or row[0] == 0:
            break
        state = row
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(star.union(least.select("u", "m")).distinct(), name)
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"id": rows["id"], "h": [shingles(t).view(np.int64) for t in rows["text"]]})


def companioned(sets: DataFrame) -> DataFrame:
    """The sets that share enough of their ``PERMS`` minima with others, all others taken together, to have a near copy.

    A minimum that no other set has cannot agree with any; texts that only have a passage in common keep too many such.
    """
    place = F.posexplode(F.expr(f"transform(sequence(0, {PERMS - 1}), i -> substring(sign, 8 * i + 1, 4))")).alias("place", "value")
    single = sets.select("id", place).groupBy("place", "value").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    alone = single.groupBy("id").agg(F.count("*").alias("alone")).where(F.col("alone") > PERMS - SHARED).select("id")
    return sets.join(alone, "id", "left_anti")


def torn(sets: DataFrame, of: DataFrame) -> DataFrame:
    """``(id, c, n)``: the sets with their components ``c`` that share a bucket with a set of another component."""
    marked = sets.select("id", F.col("n_shingles").alias("n"), "bands").join(of, "id", "left")
    marked = written(marked.select("id", "n", "bands", F.coalesce("component", "id").alias("c")), "dedup-marked")
    rows = marked.select("id", "c", F.posexplode("bands").alias("band", "key"))
    keys = rows.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band", "key")
    ids = rows.join(small(written(keys, "dedup-torn-keys")), ["band", "key"], "left_semi").select("id").distinct()
    return written(marked.select("id", "c", "n").join(ids, "id", "left_semi"), "dedup-torn")


def second_leaders(ids: DataFrame, sets: DataFrame, turn: int) -> DataFrame:
    """Pairs ``(a, b)`` of each torn set ``(id, c)`` with one member of the component that has most of its bucket, another in each turn."""
    b = sets.select("id", "bands").join(ids.select("id", "c"), "id").select("id", "c", F.posexplode("bands").alias("band", "key"))
    parts = b.groupBy("band", "key", "c").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("lead"))
    most = parts.groupBy("band", "key").agg(F.max(F.struct("m", "c", "lead")).alias("most"), F.count("*").alias("k")).where("k > 1")
    most = small(written(most.select("band", "key", F.col("most.c").alias("cl"), F.col("most.lead").alias("b")), "dedup-second"))
    return written(b.join(most, ["band", "key"]).where("c <> cl").select(F.col("id").alias("a"), "b").distinct(), "dedup-second-stars")


def crossing(ids: DataFrame, sets: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of different components among the sets ``(id, c, n)``: all that share a bucket and can be links; and ``(id, h)``, the sets' shingles."""
    hashes = texts_of(ids.select("id"), sets, docs).mapInPandas(_hashes, "id long, h array<long>").join(ids, "id")
    rows = whole = written(hashes, "dedup-shingles")
    # Of a link of x at least 75 % of x is overlap, and all overlap is of shingles that two components hold. The second
    # round counts only what the sets that are left hold.
    for k in range(2):
        each = rows.select("id", "c", "n", F.explode("h").alias("h"))
        held = each.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("h", "df")
        each = each.join(small(written(held, "dedup-held")), "h").groupBy("id", "c", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("r"))
        rows = each.withColumn("most", F.size("r")).where(f"100 * most >= {PERCENT} * n")
        rows = rows if k else written(rows.select("id", "c", "n", F.col("r.h").alias("h")), "dedup-left")
    rows = written(rows.withColumn("common", F.expr(f"size(filter(r, x -> x.df > {RARE}))")), "dedup-bounds")
    # The overlap is at most the lesser of two bounds, and the union the two sizes less the overlap.
    may = f"{100 + PERCENT} * least(most, mb) >= {PERCENT} * (n + nb)"

    # In one order of all shingles, the first of an overlap is among the first most - need + 1 of both sets.
    first = F.expr(f"filter(slice(r, 1, int(most - ({PERCENT} * n + 99) div 100 + 1)), x -> x.df <= {RARE})")
    x = rows.select("id", "c", "n", "most", F.explode(F.transform(first, lambda s: s["h"])).alias("h"))
    y = x.select("h", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"))
    by_shingle = x.join(y, "h").where(f"id > b AND c <> cb AND {may}").select(F.col("id").alias("a"), "b")

    # Pairs without a rare shingle in common: in the first of their common buckets.
    rest = rows.where(f"100 * common >= {PERCENT} * n").select("id", "c", "n", F.col("common").alias("most"))
    rest = written(sets.select("id", "bands").join(rest, "id"), "dedup-rest")
    x = rest.select("*", F.posexplode("bands").alias("band", "key"))
    sizes = x.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi")
    x = x.join(small(written(sizes.select("band", "key", F.expr(f"1 + m div {SALT}").alias("salts")), "dedup-crowds")), ["band", "key"])
    y = x.select("band", "key", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"),
                 F.col("most").alias("mb"), F.col("bands").alias("bb"))
    once = f"band = array_min(filter(sequence(0, {BANDS - 1}), i -> bands[i] = bb[i]))"
    x = x.withColumn("salt", F.expr("pmod(xxhash64(id), salts)"))
    by_bucket = x.join(y, ["band", "key", "salt"]).where(f"id > b AND c <> cb AND {may} AND {once}").select(F.col("id").alias("a"), "b")
    return by_shingle.union(by_bucket).distinct(), whole.select("id", "h")


def proved(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that are links by their full sets ``(id, h)``."""
    a, b = (whole.select(F.col("id").alias(c), F.col("h").alias(f"h_{c}")) for c in "ab")
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "h_a", "h_b").mapInPandas(_overlapping, "a long, b long"), "dedup-links")


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id, first)`` per row; ``first`` is true for the class's own row."""
    rows = written(profiles(docs), "dedup-profiles")
    # Rows without an id come last, so that they stand for a class only if they are alone.
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("loose"), "doc_id", "text_key"))
    sets = rows.where("n_shingles > 0").groupBy("k1", "k2").agg(
        rep.alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    sets = written(sets.withColumn("id", F.monotonically_increasing_id()), "dedup-sets")  # the ids hold once they are written
    near = written(companioned(sets), "dedup-near-sets")
    buckets = near.select("id", F.posexplode("bands").alias("band", "key"))
    leaders = buckets.groupBy("band", "key").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = buckets.join(small(written(leaders, "dedup-leaders")), ["band", "key"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    links = verified(stars, near, docs)
    of = components(links)
    ids = torn(near, of)
    for turn in range(TURNS):
        if ids.isEmpty():
            break
        more = verified(second_leaders(ids, near, turn), near, docs)
        if more.isEmpty():
            break
        links = links.union(more)
        of = components(links)
        ids = torn(near, of)
    if not ids.isEmpty():
        of = components(links.union(proved(*crossing(ids, near, docs))))
    of = written(sets.select("k1", "k2", "rep", "id").join(of, "id", "left").withColumn("c", F.coalesce("component", "id")), "dedup-classes")
    least = small(written(of.groupBy("c").agg(F.min("rep").alias("least")), "dedup-least"))
    of = of.join(least, "c").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "least")
    out = rows.select("doc_id", "text_key", "n_shingles", "k1", "k2").join(of, (rows["k1"] == of["_1"]) & (rows["k2"] == of["_2"]), "left")
    named = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    first = F.col("least").isNull() | F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key"))
    return out.select("doc_id", "text_key", "n_shingles", named.alias("component_id"), first.alias("first"))


def report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row."""
    with passing(docs.sparkSession), light_batches(docs.sparkSession):
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
        return written(classes(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept")), "dedup-report", keep=True)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns that the documents came with."""
    with passing(docs.sparkSession), light_batches(docs.sparkSession):
        found = classes(docs).groupBy("doc_id", "text_key", "first").agg(F.count("*").alias("n"), F.max("n_shingles").alias("n_shingles"))
        repeated = "first AND n > 1 AND (n_shingles > 0 OR doc_id IS NOT NULL)"
        found = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "first", F.expr(repeated).alias("again"))
        found = written(found.where("NOT first OR again"), "dedup-found", keep=True)
    key = F.xxhash64(docs["text"])

    def joined(keys: DataFrame, how: str) -> DataFrame:
        keys = small(keys)
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["_doc"]) & (key == keys["_key"]), how)

    again = found.where("again")
    if again.isEmpty():
        return joined(found, "left_anti")
    own = next(c for c in ("_key" + "_" * i for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    once = joined(again, "left_semi").withColumn(own, key).dropDuplicates(["doc_id", own]).select(docs.columns)
    return joined(found, "left_anti").unionByName(once)


def op4_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: Exact links by shingles in common; brute force, so for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT rid, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT rid, rid AS t FROM w UNION SELECT r.rid, e.y FROM r JOIN e ON e.x = r.t),
c AS (SELECT r.rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.t GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept FROM w JOIN c USING (rid) LEFT JOIN n USING (rid)
"""
