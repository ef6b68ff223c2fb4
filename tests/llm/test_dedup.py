"""Repeats, near duplicates, components, quality, lines and decontamination against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtick.llm import decontam, lines, neardup, quality, repeats
from loomtick.llm.graph import components

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def frame(spark, rows, extra=""):
    """(doc_id, text) with columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"key": F.lit("x"), "label": F.lit(1), "n": F.lit(2), "k1": F.lit(3), "source": F.lit("s")})


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


EDGES = [(1, None), (2, ""), (2, ""), (None, "tiny"), (None, "tiny")]


def test_repeats_match_brute_force(spark):
    rng = random.Random(4)
    passage = prose(rng, 30)
    rows = [(i, prose(rng, 20) + passage[rng.randrange(40) :] + prose(rng, 10)) for i in range(12)]
    rows += [(50, prose(rng, 90)), (51, "ab" * 400), (52, "é" * 300 + prose(rng, 20)), (53, rows[0][1]), (53, rows[0][1]), (54, "x" * 130 + "\0" + "x" * 129), *EDGES]
    thue = "a"
    while len(thue) < 4096:
        thue += thue.translate({97: "b", 98: "a"})
    rows += [(60, thue[:1100]), (61, thue[1024:2200]), (62, thue[700:3000]), (63, "z" + thue[:2500])]
    for length in (400, 100, 2000):
        got = sorted(map(tuple, repeats.without_repeats(frame(spark, rows), length).drop("spans", "n_passage").collect()), key=str)
        want = sorted(((r[0], *b) for r, b in zip(rows, brute.repeats([r[1] for r in rows], length), strict=True)), key=str)
        assert got == want


def test_passages_too_short_to_go_are_reported(spark):
    rng = random.Random(14)
    passage = prose(rng, 60)[:330]
    rows = [(i, prose(rng, 80) + " " + passage + " " + prose(rng, 80)) for i in range(3)] + [(9, prose(rng, 200))]
    got = {r.doc_id: (r.n_removed, r.n_passage > 0) for r in repeats.without_repeats(frame(spark, rows)).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 9: (0, False)}


def test_only_places_that_share_enough_are_sorted(spark, monkeypatch):
    rng = random.Random(15)
    short, long = prose(rng, 60)[:350], prose(rng, 120)[:600]
    around = lambda x: prose(rng, 80) + " " + x + " " + prose(rng, 80)
    sorted_, before = [], repeats._contexts

    def counted(rows, length):
        out = before(rows, length)
        sorted_.append(sum((r.hi - r.lo + 1 for r in out.collect()), 0))
        return out

    monkeypatch.setattr(repeats, "_contexts", counted)
    removed = [sum(r.n_removed for r in repeats.without_repeats(frame(spark, [(i, around(x)) for i in range(6)])).collect()) for x in (short, long)]
    assert removed[0] == 0 and removed[1] >= 6 * 600
    assert sorted_[0] == 0 < sorted_[1]


def test_texts_taken_together_agree_with_each(monkeypatch):
    rng = random.Random(16)
    texts = [prose(rng, rng.choice([0, 1, 50, 90, 300])).encode() for _ in range(60)] + [b"a" * 399, b"a" * 400, b"b" * 3000, b""]
    rng.shuffle(texts)
    want = sorted((i, *map(int, x)) for i, text in enumerate(texts) for c in repeats.text_phrases(text, 400) for x in zip(*c, strict=True))
    for size in (1, 700, 5000, 1 << 20):
        monkeypatch.setattr(repeats, "JOINED", size)
        got = [tuple(map(int, x)) for of, c in repeats.joined_phrases(texts, 400) for x in zip(of, *c, strict=True)]
        assert sorted(got) == want
    t, lo, hi = (np.array(c) for c in zip(*(x[2:] for x in want), strict=True))
    assert [x.tolist() for x in repeats.unpacked_places(repeats.packed_places(t, lo, hi))] == [t.tolist(), lo.tolist(), hi.tolist()]


def test_classes_share_what_their_strings_share(monkeypatch):
    rng = random.Random(17)
    for length in (64, 100, 400, 2000):
        passage = prose(rng, 700).encode()[:4000]
        data = [prose(rng, 20).encode() + passage + prose(rng, 20).encode() for _ in range(2)]
        found, step = [], repeats.class_of(length)
        for piece in (1 << 20, 512):
            monkeypatch.setattr(repeats, "PIECE", piece)
            each = []
            for text in data:
                t, lo, hi = (np.concatenate(c) for c in list(zip(*repeats.text_phrases(text, length), strict=True))[1:])
                hashes = repeats.class_hashes(text, t, lo, hi, length)
                places = {p: (d := int(a - p), hashes[d // step][i]) for i, (a, b, c) in enumerate(zip(t, lo, hi, strict=True)) for p in range(b, c + 1)}
                assert len(places) == len(text) - length + 1 and not any(h is np.ma.masked for _, h in places.values())
                each.append({text[p : p + length]: x for p, x in places.items()})
            found.append(each)
            both = each[0].keys() & each[1].keys()
            assert len(both) >= 4000 - length + 1 and all(each[0][s] == each[1][s] for s in both)
        assert [[sorted(x.values()) for x in e] for e in found][0] == [[sorted(x.values()) for x in e] for e in found][1]


def test_repeats_parts_agree_with_whole(monkeypatch):
    rng = random.Random(9)
    data = prose(rng, 900).encode() + b"a" * 2000
    each = lambda: {(int(t), int(p), int(k)) for c in repeats.text_phrases(data, 400) for k, t, lo, hi in zip(*c, strict=True) for p in range(lo, hi + 1)}
    whole = each()
    monkeypatch.setattr(repeats, "PIECE", 512)
    assert whole == each() and {p for _, p, _ in whole} == set(range(len(data) - 399))


def test_intervals_of_an_order_over_partitions():
    rng = random.Random(12)
    texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12))) for _ in range(300)})
    from types import SimpleNamespace

    edges, steps_of, at = {}, {}, 0
    for part in range(9):  # as the partitions of a sort would do
        own = texts[at : at + (size := 40 if part != 3 else 1)]
        at += size
        steps, before = [], None
        for i, s in enumerate(own):
            shared = repeats.common(before, s) if before else 0
            steps = repeats.cut(steps, shared) + ([(len(s), (part << 36) + i)] if len(s) > shared else [])
            steps_of[s], before = steps, s
            for bit, end in ((1, i == 0), (2, i == len(own) - 1)):
                if end:
                    edges[part, bit] = SimpleNamespace(s=s, depths=[d for d, _ in steps], intervals=[x for _, x in steps])
    carry = repeats.carried(edges)
    named = {(s, r): repeats.interval([d for d, _ in st], [i for _, i in st], carry, r)[0] for s, st in steps_of.items() for r in range(1, len(s) + 1)}
    for (s, r), x in named.items():
        for u, y in ((u, named[u, r]) for u in steps_of if len(u) >= r):
            assert (s[:r] == u[:r]) == (x == y)
    split = lambda st: ([d for d, _ in st], [i for _, i in st])
    for _ in range(300):
        s, u = (rng.choice(texts[: len(steps_of)]) for _ in range(2))
        length = rng.randrange(1, len(s) + len(u) + 1)
        first, last = max(0, length - len(u)), min(len(s), length - 1)
        runs = [(x, y, d + k) for x, y, d, n in repeats.shared_runs(split(steps_of[s]), split(steps_of[u]), (carry, carry), length, first, last) for k in range(n)]
        assert runs == [(named[s, d] if d else -1, named[u, length - d], d) for d in range(first, last + 1)]


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(12):
        base = prose(rng, 120).split()
        for j in range(rng.randrange(1, 7)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = "changed" + str(rng.randrange(1000))
            rows.append((100 * i + j, " ".join(own)))
    rows += [(9000, rows[0][1]), (9001, "two words"), (9002, "Two  words!"), *EDGES]
    got = sorted((tuple(r)[:4] for r in neardup.jaccard_join(frame(spark, rows), block_texts=3).select("doc_id", "class_id", "n_copies", "n_links").collect()), key=str)
    assert got == brute.classes(rows, 0.8)
    kept = neardup.one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(x[1]) for x in brute.classes(rows, 0.8)})


def test_buckets_and_clusters_give_the_same_links(spark):
    rng = random.Random(41)
    rows, n = [], 0
    own = prose(rng, 60).split()  # a chain: neighbours are near copies, the ends are not
    for _ in range(200):
        rows.append((n := n + 1, " ".join(own)))
        own[rng.randrange(len(own))] = f"step{n}"
    rows += [(900 + i, prose(rng, 60)) for i in range(10)]
    docs = frame(spark, rows)
    want = brute.classes(rows, 0.8)
    texts = neardup.signatures(docs, 23, 6).select("key", "bands", "n_chars")
    shared, clusters = neardup.candidates(texts)
    kinds = [{r.band is None for r in neardup.groups_of(shared, clusters, texts, block).select("band").collect()} for block in (2, 128)]
    assert False in kinds[0] and kinds[1] == {True}
    got = neardup.jaccard_join(docs, block_texts=2).select("doc_id", "class_id", "n_copies", "n_links").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_one_of_each_keeps_unrelated_texts_of_equal_ids(spark):
    rng = random.Random(17)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (5, c), (5, d), (5, d), (7, d), (None, e), (9, e + " more"), (None, "one"), (None, "")]
    kept = sorted((str(r.doc_id), r.text) for r in neardup.one_of_each(frame(spark, rows)).collect())
    assert kept == sorted([("None", a), ("None", b), ("5", c), ("5", d), ("9", e + " more"), ("None", "one"), ("None", "")])


def test_jaccard_join_of_empty_table(spark):
    empty = frame(spark, [(1, "x")]).where("doc_id < 0")
    assert neardup.jaccard_join(empty).count() == 0 and neardup.one_of_each(empty).count() == 0
    assert repeats.without_repeats(empty).count() == 0


def test_bands_reach_the_recall():
    b, r = neardup.bands_for(0.8, 0.999, 150)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 150


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = sorted({(x, find(x)) for p in pairs for x in p if p[0] != p[1]})
    assert sorted(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect())) == want


def test_quality_matches_brute_force(spark):
    rng = random.Random(2)
    line = prose(rng, 12)
    texts = [prose(rng, rng.randrange(0, 80)) for _ in range(20)] + [line + "\n" + prose(rng, 60) + "\n" + line, "a b c d e " * 30, "x y z " * 9, "# * $\n# * $\n\n", "word"]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(10)]
    rows = [*enumerate(texts), *EDGES]
    got = sorted((tuple(r) for r in quality.quality(frame(spark, rows)).collect()), key=str)
    want = []
    for d, t in rows:
        *plain, failed, covered, longest = brute.quality(t)
        longest = longest if longest >= 5 else 0
        n = plain[0]
        kept = not failed and covered <= quality.MAX_COVERED * n and not (longest > quality.MAX_REPEAT and longest > quality.MAX_REPEAT_FRACTION * n)
        want.append((d, *plain, failed, kept, covered, longest))
    assert got == sorted(want, key=str)
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if w[7])


def test_quality_longest_repeat_rejects(spark):
    rng = random.Random(3)
    part = prose(rng, 80)
    text = " ".join([part, prose(rng, 1700), part])
    row = quality.quality(frame(spark, [(1, text), (2, prose(rng, 1860))])).orderBy("doc_id").collect()
    assert (row[0].base_failed, row[0].kept, row[0].longest_repeat) == (False, True, 80)  # long, but less than a twentieth
    row = quality.quality(frame(spark, [(1, " ".join([part, prose(rng, 700), part]))])).collect()[0]
    assert not row.base_failed and not row.kept


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_line_dedup(spark, limit):
    rows = [(i, f"shared line\nown {i}\n\n  shared line ", "h1") for i in range(8)] + [(20, "shared line\nx", "h2"), (21, None, "h2"), (22, "", None)]
    rows += [(30 + i, f"rare\nown{i}" if i < 6 else f"own{i}", "h3") for i in range(100)] + [(40, "again", None)] * 6
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("clash")).withColumn("marks", F.lit(0))
    got = lines.drop_boilerplate(df, broadcast_lines=limit)
    out = {(r.doc_id, r.source): (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert got.count() == len(rows) and got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert out[(3, "h1")] == ("own 3\n", 4, 2)
    assert out[(20, "h2")] == ("shared line\nx", 2, 0)  # too few pages
    assert out[(21, "h2")] == ("", 1, 0) and out[(22, None)] == ("", 1, 0)
    assert out[(31, "h3")] == ("rare\nown1", 2, 0)  # 6 of 100 pages
    assert out[(40, None)] == ("", 1, 1)  # a null host is a host; 6 of its 7 pages
    assert lines.drop_boilerplate(df.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_decontamination(spark, limit):
    rng = random.Random(6)
    items = [(1, prose(rng, 30)), (1, None), (2, "too short here"), (3, prose(rng, 6)), (4, prose(rng, 30)), (5, "..")]
    near = items[0][1].split()
    near[0] = "changed"  # one shingle of 26 goes
    rows = [(10, prose(rng, 400) + " " + items[0][1].upper() + "! " + prose(rng, 400)), (11, " ".join(near)), (12, prose(rng, 50)), (13, " ".join(items[4][1].split()[:12])), (14, items[3][1]), (14, items[3][1]), (15, "Too short, here!"), (16, "one too short here"), *EDGES]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(5)).union(spark.createDataFrame([(1, items[0][1])], "item_id long, text string").withColumn("item", F.lit(5)))
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contained(frame(spark, rows), bench, broadcast_rows=limit).collect())
    assert got == [(10, 1, 26, 26), (11, 1, 25, 26), (14, 3, 2, 2), (14, 3, 2, 2), (15, 2, 1, 1)]
    left = decontam.decontaminated(frame(spark, rows), bench, broadcast_rows=limit)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (10, 11, 14, 15))
    assert left.columns == frame(spark, rows).columns
    assert decontam.contained(frame(spark, rows), bench.where("item_id < 0")).count() == 0
