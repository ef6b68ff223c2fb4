"""N-gram Jaccard self-join by MinHash banding.

1. Each text becomes its set of five-word shingles and a MinHash signature, cut into
   bands whose number and length follow from the threshold and the target recall.
2. Band hashes are shuffled; texts that share one form candidate clusters (every
   band bucket points to its smallest member, so a bucket of any size gives as many
   edges as it has members).
3. Pairs are verified on the full shingle sets, in groups: a cluster, or where that
   moves fewer texts (a cluster that a few chance bands chain together), each band
   bucket of it, a pair then counting in its first common band alone.  A large group
   is cut into blocks, and each pair of blocks is a task of bounded size; only counts
   and a spanning forest of the verified links leave it.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtick.llm.common import discard, fresh, in_arrow, text_key, text_slices, written
from loomtick.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 150
#: Texts in a block, and characters of their texts in it (a longer text has a block of its own).
BLOCK_TEXTS = 128
BLOCK_CHARS = 4_000_000
#: Keys of texts in groups are broadcast up to this number (16 bytes each), so other texts are not shuffled; more are joined by key.
BROADCAST_KEYS = 1 << 19
_WORD = re.compile(r"\w+")


@functools.lru_cache
def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that find a pair at the threshold with the recall, in ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted 64-bit hashes of a text's distinct shingles; word hashes are kept."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.factors = np.random.default_rng(11).integers(1 << 62, size=WORDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words = _WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 300_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        k = min(WORDS, len(words))  # a text of fewer words is one shingle
        m = len(words) - k + 1
        out = np.full(m, k, np.uint64)
        for i in range(k):
            out = out + h[i : i + m] * self.factors[i]
        return np.unique(_mixed(out))


def signature_bands(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of the MinHash signature."""
    rng = np.random.default_rng(23)
    n = bands * rows
    a = rng.integers(1 << 62, size=n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1 << 62, size=n).astype(np.uint64)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * a + b
        part ^= part >> np.uint64(32)
        low = np.minimum(low, (part * a[::-1]).min(0))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + low[i::rows])
    return out.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, n_chars, bands) of every row; a text without words has no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in text_slices(batches, 2):
            sizes, found = [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                s = shingler(text)
                sizes.append(len(text))
                found.append(signature_bands(s, bands, rows) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "n_chars", "bands"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    return picked.transform(in_arrow, run, "doc_id long, key binary, n_chars long, bands array<long>")


def candidates(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, band, m): texts in buckets of m > 1 texts; (key, cluster): those that common bands join."""
    rows = texts.select("key", F.explode("bands").alias("band"))
    buckets = rows.groupBy("band").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = written(rows.join(written(buckets, "buckets"), "band"), "shared-bands")
    edges = shared.where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    return shared.select("key", "band", "m"), components(edges).select(F.col("node").alias("key"), F.col("label").alias("cluster"))


def groups_of(shared: DataFrame, clusters: DataFrame, texts: DataFrame, block_texts: int) -> DataFrame:
    """(key, grp, band, n_blocks): the groups in which a text meets others; band is null in a group that is a cluster.

    A text goes to as many tasks as its group has blocks.  Each cluster is taken whole or
    by its buckets, whichever comes to fewer.  Clusters or buckets only meet here as
    counts; that of one text follows from what is summed up for each.
    """
    blocks = lambda n, chars: F.greatest(F.ceil(n / block_texts), F.ceil(chars / BLOCK_CHARS)).cast("int")
    members = written(clusters.join(texts.select("key", "n_chars"), "key"), "members")
    whole = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    whole = whole.select("cluster", blocks(F.col("n"), F.col("chars")).alias("n_blocks"), "n")
    rows = written(shared.join(members, "key"), "bucket-members")
    buckets = rows.groupBy("cluster", "band").agg(F.first("m").alias("m"), F.sum("n_chars").alias("chars"))
    buckets = written(buckets.select("cluster", "band", "m", blocks(F.col("m"), F.col("chars")).alias("n_blocks")), "bucket-sizes")
    moved = buckets.groupBy("cluster").agg(F.sum(F.col("m") * F.col("n_blocks")).alias("by_band"))
    chosen = written(whole.join(moved, "cluster").select("cluster", "n_blocks", (F.col("by_band") < F.col("n") * F.col("n_blocks")).alias("split")), "clusters")
    one = members.join(chosen.where("not split"), "cluster").select("key", F.col("cluster").alias("grp"), F.lit(None).cast("long").alias("band"), "n_blocks")
    split = buckets.join(chosen.where("split").select("cluster"), "cluster", "left_semi")
    many = rows.select("key", "cluster", "band").join(split.select("cluster", "band", "n_blocks"), ["cluster", "band"])
    groups = written(one.unionByName(many.select("key", F.col("cluster").alias("grp"), "band", "n_blocks")), "groups")
    discard(members, rows, buckets, chosen)
    return groups


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets."""
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.int64).reshape(len(left), len(right))
    values, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    who = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    # columns that only one set has can be left out; the others are taken in strips
    often = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(often) - 1
    keep = often[place]
    who, place = who[keep], column[place[keep]]
    n_columns = int(often.sum())
    out = np.zeros((len(left), len(right)), np.float64)
    strip = max(1, (1 << 24) // (len(left) + len(right)))
    order = np.argsort(place, kind="stable")
    who, place = who[order], place[order]
    for start in range(0, n_columns, strip):
        lo, hi = np.searchsorted(place, (start, start + strip))
        grid = np.zeros((len(left) + len(right), min(strip, n_columns - start)), np.float32)
        grid[who[lo:hi], place[lo:hi] - start] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return np.rint(out).astype(np.int64)


def block_links(keys: list[bytes], sides: list[int], sets: list[np.ndarray], same: bool, threshold: float, band: int | None = None, bands: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Number of verified links of each text of a pair of blocks, and a spanning forest of them.

    With a band, only pairs whose first common one it is.
    """
    left = [i for i, s in enumerate(sides) if s == 0 or same]
    right = [i for i, s in enumerate(sides) if s == 1 or same]
    counts = np.zeros(len(keys), np.int64)
    if not left or not right:
        return counts, []
    shared = shared_counts([sets[i] for i in left], [sets[i] for i in right])
    size = np.array([len(s) for s in sets])
    union = size[left][:, None] + size[right][None, :] - shared
    hit = (shared >= threshold * union) & (union > 0)
    if band is not None:
        own, other = np.stack([bands[i] for i in left]), np.stack([bands[i] for i in right])
        at = int(np.flatnonzero(own[0] == band)[0])
        for i in range(at):
            hit &= own[:, i, None] != other[None, :, i]
    if same:
        np.fill_diagonal(hit, False)
        counts[left] = hit.sum(1)
    else:
        counts[left] += hit.sum(1)
        counts[right] += hit.sum(0)
    root = list(range(len(keys)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for x, y in zip(*np.nonzero(hit), strict=True):
        a, b = find(left[x]), find(right[y])
        if a != b:
            root[a] = b
            forest.append((left[x], right[y]))
    return counts, forest


def verified_links(docs: DataFrame, groups: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n): spanning links (n null) and link counts of a text (b null), from whole sets."""
    whole = docs.select(text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    keys = written(groups.select("key").distinct(), "group-keys")
    whole = whole.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    split = groups.where("band IS NOT NULL").select("key").distinct()
    bands = texts.select("key", "bands").join(split, "key", "left_semi").withColumnRenamed("key", "of")
    rows = groups.join(bands, (F.col("key") == F.col("of")) & F.col("band").isNotNull(), "left").drop("of")
    block = F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int")
    dealt = whole.join(rows, "key").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    dealt = dealt.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", side, "key", "bands", "text")
    group = ["grp", "band", "i", "j"]
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        at, keys, sides, sets, bands = None, [], [], [], []
        out: list[tuple[bytes, bytes | None, int | None]] = []

        def close() -> None:
            counts, forest = block_links(keys, sides, sets, at[1] == at[2], threshold, at[3], bands)
            out.extend((k, None, int(n)) for k, n in zip(keys, counts, strict=True) if n)
            out.extend((keys[a], keys[b], None) for a, b in forest)

        packed = lambda: pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "n"])
        for batch in text_slices(batches, 7):
            head = list(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True))
            for (grp, i, j, band, side, key, own), value in zip(head, batch.column(7), strict=True):
                if at != (grp, i, j, band):
                    if at is not None:
                        close()
                    at, keys, sides, sets, bands = (grp, i, j, band), [], [], [], []
                keys.append(key)
                sides.append(side)
                bands.append(None if own is None else np.array(own, np.int64))
                sets.append(shingler(value.as_py() or ""))
            if len(out) > 10_000:
                yield packed()
                out.clear()
        if at is not None:
            close()
        yield packed()

    return dealt.transform(in_arrow, run, "a binary, b binary, n long")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block_texts: int = BLOCK_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, first, n_copies, n_links, label) of every text; a class is a label."""
    rows = written(signatures(docs, *bands_for(threshold, recall, MAX_HASHES)), "signatures")
    texts = written(rows.groupBy("key").agg(F.first("bands").alias("bands"), F.max("n_chars").alias("n_chars"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies")), "texts")
    groups = groups_of(*candidates(texts), texts, block_texts)
    links = written(verified_links(docs, groups, texts, threshold), "links")
    discard(groups)
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    classes = components(links.where("b IS NOT NULL")).withColumnRenamed("node", "key")
    each = texts.select("key", "first", "n_copies").join(counts, "key", "left").join(classes, "key", "left")
    return rows, written(each.withColumn("label", F.coalesce("label", "key")), "classes")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links, key) for each row of ``docs``.

    Texts are linked if the Jaccard similarity of their five-word shingle sets is at
    least ``threshold``; candidates are found with the target recall, and every
    candidate pair is verified on the full sets.  class_id is the smallest doc_id of
    the texts that links join (with their copies); n_copies the number of rows with
    this very text, n_links the number of other texts linked to it.  A text without
    words links to nothing but its copies.  A null text counts as empty; a null
    doc_id is larger than any other, and alone it gives a null class.
    """
    rows, each = text_classes(docs, threshold, recall, block_texts)
    firsts = written(each.groupBy("label").agg(F.min("first").alias("class_id")), "class-ids")
    each = written(each.join(firsts, "label").select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "text-classes")
    # at most 1000 texts have a thousandth of all rows each: their rows meet them without being dealt by key
    often = each.where(F.col("n_copies") * 1000 >= rows.count())
    rows = rows.select("doc_id", "key")
    out = rows.join(F.broadcast(often), "key").unionByName(rows.join(F.broadcast(often.select("key")), "key", "left_anti").join(each, "key"))
    return out.select("doc_id", "class_id", "n_copies", "n_links", "key")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row of each class of ``jaccard_join``, with its columns: that of the smallest doc_id.

    A class is what links join, whatever its ids: unrelated texts under null ids or
    under one repeated id are classes of their own.  Of a class, null ids come last,
    and of texts with equal ids the smallest key is taken.  Copies are summed up on
    the map side first, so no text gathers its copies in one task.
    """
    _, each = text_classes(docs, threshold, recall)
    heads = each.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "key")).alias("head"))
    heads = written(heads.select(F.col("head.key").alias("head")), "heads")
    name, row = fresh(docs, "lt_key"), fresh(docs, "lt_row")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    kept = docs.groupBy(text_key(F.col("text").cast("string")).alias(name)).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return kept.join(heads, F.col(name) == F.col("head"), "left_semi").select(f"{row}.*")


#: All pairs that share a shingle; components by closure.  For small tables.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first, count(*) AS n_copies FROM documents GROUP BY 1),
k AS (SELECT row_number() OVER (ORDER BY first, text) AS id, * FROM t),
w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM k),
s AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) ELSE [array_to_string(w, ' ')] END AS sh FROM w WHERE len(w) > 0),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS gram FROM s),
l AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= @T@ * (a.n + b.n - count(*))),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS id, min(k.first) AS class_id FROM r JOIN k ON k.id = r.b GROUP BY 1),
n AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, k.first) AS class_id, k.n_copies, coalesce(n.n_links, 0)::BIGINT AS n_links
FROM documents d JOIN k ON k.text = coalesce(d.text, '') LEFT JOIN c USING (id) LEFT JOIN n USING (id)
""".replace("@T@", str(THRESHOLD))
