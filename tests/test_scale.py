"""What must hold for one tree, one file or one text of any size: spread paths against plain ones on small inputs."""

import gzip
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import edges as ed
from strandloom.operators import graph as gr
from strandloom.operators import pairs
from strandloom.operators import sketch as sk
from strandloom.operators.delta import best_shift, decode, encode
from strandloom.plans import archive
from strandloom.sources import fastx
from strandloom.sources import reads as src

EDGE = "rid long, prid long, shift int, dif int, isrc int"


def plain_distances(ends):
    out, used = {}, []
    for low, high in sorted(ends):
        out[low] = high - low - sum(low < x < high for x in used)
        used.append(high)
    return out


@pytest.mark.parametrize(("n", "block", "grid"), [(1, 4, 8), (150, 16, 5), (150, 1 << 18, 1024)])
def test_mates_there_and_back(spark, n, block, grid):
    slots = np.random.default_rng(n).permutation(2 * n).reshape(n, 2)
    ends = [(int(min(s)), int(max(s))) for s in slots]
    table = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "pair_id long, l long, r long")
    found = pairs.mate_distances(table, block, grid).toPandas()
    assert dict(zip(found.l, found.dist, strict=True)) == plain_distances(ends)
    back = pairs.mate_slots(spark.createDataFrame(found[["n", "dist"]]), max(1, block // 2)).collect()
    assert sorted((r.l, r.r) for r in back) == sorted(ends)


def test_counts_and_slots_in_one_task():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 7, 64, 301):
        v = rng.integers(0, max(1, n // 2), n)
        assert (pairs.smaller_before(v) == [sum(v[:i] < v[i]) for i in range(n)]).all()
        slots = sorted((int(min(s)), int(max(s))) for s in rng.permutation(2 * n).reshape(n, 2))
        dist = np.array([plain_distances(slots)[low] for low, _ in slots], np.int64)
        assert [tuple(map(int, x)) for x in pairs.slots_of(dist)] == slots


def forest_rows(n=200, part=60):
    rng = np.random.default_rng(5)
    ids, out = rng.permutation(n), []
    for i in range(1, n):
        if i % part:
            a, b = int(ids[i]), int(ids[int(rng.integers(max(0, i - 6), i)) if i % part > 1 else i - 1])
            out.append((max(a, b), min(a, b), int(rng.integers(-3, 4)), 1, int(rng.integers(0, 2))))
    return out


def test_tour_and_walk_agree_and_texts_grow_back(spark):
    """forest_nodes: every tree rooted at its least id, one row a node, depths and preorder of a depth-first walk."""
    forest = spark.createDataFrame(forest_rows(), EDGE)
    walked, toured = (sorted(map(tuple, gr.rooted(forest, most).collect())) for most in (10**6, 0))
    assert walked == toured
    near = {(r[0], r[1]): (r[2], r[4]) for r in forest_rows()}
    depth, last = {}, {}
    for read_id, prid, shift, isrc, root, d, preorder, back in sorted(walked, key=lambda r: (r[4], r[6])):
        depth[read_id] = 0 if read_id == prid else depth[prid] + 1
        assert d == depth[read_id] and preorder == last.get(root, (-1,))[0] + 1
        assert back == (last[root][1] - d + 1 if preorder else 0)
        last[root] = (preorder, d)
        if read_id != prid:
            want, turn = near[max(read_id, prid), min(read_id, prid)]
            assert isrc == turn and shift == (want if read_id > prid or isrc else -want)
    rng, texts, rows = random.Random(4), {}, []
    for read_id, prid, shift, isrc, root, _, preorder, _ in sorted(walked, key=lambda r: (r[4], r[6])):
        if read_id == prid:
            s, delta = ("".join(rng.choice("ACGTN") for _ in range(30)),) * 2
        else:
            n = 30 if read_id % 3 else 23
            c = (("T" * max(0, -shift)) + texts[prid][max(0, shift) :] + "ACGT" * 9)[:n]
            c = c[:5] + "G" + c[6:]
            delta, s = encode(texts[prid], c, shift), c[::-1].translate(archive.COMPLEMENT) if isrc else c
        texts[read_id] = s
        rows.append((root, preorder, prid, read_id, shift, isrc, delta, len(s)))
    nodes = spark.createDataFrame(rows, archive.NODES)
    for most in (10**6, 0):
        assert {r.read_id: r.seq[::-1] for r in archive.grown(nodes, most).collect()} == texts


@pytest.mark.parametrize("shape", ["path", "star"])
def test_one_large_tree_is_spread(spark, shape):
    n = 50_000
    prid = F.col("id") - 1 if shape == "path" else F.lit(0).cast("long")
    edges = spark.range(1, n).select(F.col("id").alias("rid"), prid.alias("prid"), F.lit(1).alias("shift"), F.lit(0).alias("isrc"), F.lit(0).cast("long").alias("root"))
    rows = gr.toured(edges)
    assert rows.count() == n
    assert rows.where("preorder <> read_id").count() == 0
    assert rows.where("depth <> " + ("read_id" if shape == "path" else "least(read_id, 1)")).count() == 0


def test_deep_chain_grows_back(spark):
    n = 50_000
    i = F.col("id")
    last = F.substring(F.lit("ACGT"), (F.pmod(i + 9, F.lit(4)) + 1).cast("int"), F.lit(1))
    chain = spark.range(n).select(F.lit(0).cast("long").alias("root"), i.alias("preorder"), F.greatest(i - 1, F.lit(0)).alias("prid"), i.alias("read_id"), F.when(i > 0, 1).otherwise(0).alias("shift"), F.lit(0).alias("isrc"), F.when(i == 0, F.lit("ACGTACGTAC")).otherwise(last).alias("delta"), F.lit(10).alias("length"))
    want = F.substring(F.repeat(F.lit("ACGT"), 4), (F.pmod("read_id", F.lit(4)) + 1).cast("int"), F.lit(10))
    got = archive.grown(chain, 1000)
    assert got.count() == n and got.where(F.reverse("seq") != want).count() == 0


def kruskal(rows):
    above, out = {}, []

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for dif, rid, prid, shift, isrc in sorted(rows):
        a, b = top(rid), top(prid)
        if a != b:
            above[a] = b
            out.append((dif, rid, prid, shift, isrc))
    return sorted(out)


def test_forest_of_sets_is_that_of_their_union(spark):
    rng = random.Random(8)
    rows = [(max(a, b), min(a, b), rng.randrange(-2, 3), rng.randrange(1, 6), rng.randrange(2)) for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(300)) if a != b]
    table = spark.createDataFrame(rows, EDGE)
    want = kruskal([(dif, rid, prid, shift, isrc) for rid, prid, shift, dif, isrc in rows])
    order = ("dif", "rid", "prid", "shift", "isrc")
    for few in (0, 10**6):
        assert sorted(map(tuple, gr.spanning_forest(table, few).select(*order).collect())) == want
    sets = [spark.createDataFrame(rows[k::3], EDGE) for k in range(3)]
    assert sorted(map(tuple, gr.forest_of(sets).select(*order).collect())) == want
    links = table.select(F.col("rid").alias("u"), F.col("prid").alias("v"))
    assert sorted(gr.labelled(links, 0).collect()) == sorted(gr.labelled(links).collect())


def plain_sketch(seq, k, kind):
    from strandloom.functions.sequence import HASH_STEPS

    def hashed(x):
        m = (1 << 2 * k) - 1
        for step, shifts in HASH_STEPS:
            if step == "flip":
                x = (~x + (x << shifts[0])) & m
            elif step == "fold":
                x ^= x >> shifts[0]
            else:
                x = (x + sum(x << v for v in shifts)) & m
        return x

    s, found = seq[::-1], []
    for strand, text in enumerate((s, s[::-1].translate(archive.COMPLEMENT))):
        for p in range(len(text) - k + 1):
            h = hashed(int("".join(str("ACGT".index(c)) for c in text[p : p + k]), 4))
            found.append((h if kind == "min" else -h, strand, p + k - 1))
    h, strand, pos = min(found)
    return abs(h), strand, pos


def plain_edges(seqs, k, kind, threshold=90):
    """Edges of one sketch, reads looked at one by one in order."""
    rows, out = {}, []
    for i, seq in seqs.items():
        h, strand, pos = plain_sketch(seq, k, kind)
        s = seq[::-1]
        rows.setdefault(h, []).append((-pos, i, strand, s.translate(archive.COMPLEMENT)[::-1] if strand else s))
    for group in rows.values():
        group.sort()
        for at, (pos, i, strand, s) in enumerate(group):
            start = next(n for n, g in enumerate(group) if g[0] == pos)
            near = group[max(0, at - 401) : at]
            found = [(g, 0) for g in near if g[0] == pos] + [(g, pos - g[0]) for g in group[max(0, start - 401) : start]]
            weighed = []
            for (_, j, other, t), gap in found:
                dif = 3 * sum(a != b for a, b in zip(t[gap:], s, strict=False)) + gap
                if 0 < dif < threshold:
                    weighed.append((dif, j, -gap if other else gap, int(strand != other)))
            cut = sorted(d for d, *_ in weighed)[:5]
            for dif, j, s0, isrc in weighed:
                if dif <= cut[-1]:
                    out.append((max(i, j), min(i, j), -s0 if i < j and not isrc else s0, dif, isrc))
    return sorted(out)


def test_schedule_edges_and_forest_by_brute_force(spark):
    """sketch_schedule, schedule_edges, schedule_forest: all forty sketches of a small collection."""
    rng = random.Random(12)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    seqs = {}
    for i in range(40):
        at = rng.randrange(300)
        s = list(base[at : at + 100])
        s[rng.randrange(100)] = rng.choice("ACGT")
        s = "".join(s)
        seqs[i] = s[::-1].translate(archive.COMPLEMENT) if i % 4 == 0 else s
    reads = spark.createDataFrame(list(seqs.items()), "read_id long, seq string")
    want = {(k, kind): [(i, *plain_sketch(s, k, kind)) for i, s in seqs.items()] for k in range(10, 30) for kind in ("min", "max")}
    got = {}
    for r in sk.schedule(reads).collect():
        got.setdefault((r.k, r.kind), []).append((r.read_id, r.h, r.strand, r.pos))
    assert {x: sorted(v) for x, v in got.items()} == want
    found = {}
    for r in ed.edges(reads, sk.schedule(reads, (12, 21)), 90, ("k", "kind", "h")).collect():
        found.setdefault((r.k, r.kind), []).append((r.rid, r.prid, r.shift, r.dif, r.isrc))
    plain = {(k, kind): plain_edges(seqs, k, kind) for k in (12, 21) for kind in ("min", "max")}
    assert {x: sorted(v) for x, v in found.items()} == {x: v for x, v in plain.items() if v}
    every = [e for k in range(10, 30) for kind in ("min", "max") for e in plain_edges(seqs, k, kind)]
    forest = gr.forest_of(ed.schedule_sets(reads))
    assert sorted(map(tuple, forest.select("dif", "rid", "prid", "shift", "isrc").collect())) == kruskal([(d, a, b, s, i) for a, b, s, d, i in every])


def test_fastx_ranges_lose_nothing(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 60)))
        rows.append((f"r{k}", seq, "".join(rng.choice("@+I>!") for _ in seq)))
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in rows))
    (tmp_path / "b.fa").write_text("".join(f">{n}\n{s[:20]}\n{s[20:]}\n" for n, s, _ in rows))
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(b"@m\r\nACGT\r\nAC\r\n+\r\n@III\r\n+I\r\n@n\r\nA\r\n+\r\nI"))
    (tmp_path / "d.txt").write_text("")
    want = [s for _, s, _ in rows] * 2 + ["ACGTAC", "A"]
    for split in (0, 997, 1 << 20):
        got = src.numbered(src.read_fastx(spark, str(tmp_path), split)).orderBy("read_id").collect()
        assert [r.seq for r in got] == want
        assert [r.quality for r in got] == [q for _, _, q in rows] + [None] * 300 + ["@III+I", "I"]
    reader = fastx.FastxReader(str(tmp_path / "a.fq"), 1)
    assert [r[1] for p in reader.partitions() for r in reader._found(p)] == [n for n, _, _ in rows]
    (tmp_path / "e.fq").write_text("@r\nACGT\nAC\n+\nIIII\nII\n" * 50)
    assert [src.read_fastx(spark, str(tmp_path / "e.fq"), split).count() for split in (0, 100)] == [50, 50]
    # A quality that looks like a record: the range before it does not end there, which is seen.
    (tmp_path / "g.fq").write_text("@r\nACGTAC\nAC\n+\nIIII\n@x\nA\n+\nI" + "\n@s\nA\n+\nI" * 9)
    with pytest.raises(Exception, match="four lines|symbols|no record"):
        src.read_fastx(spark, str(tmp_path / "g.fq"), 20).collect()
    (tmp_path / "f.fq").write_text("@r\nACGT\n+\nII")
    with pytest.raises(Exception, match="symbols"):
        src.read_fastx(spark, str(tmp_path / "f.fq")).collect()


def test_fastx_streams(monkeypatch, tmp_path):
    """No more than two chunks of a file are held at a time, whatever its size."""
    path, n = tmp_path / "big.fq.gz", 200_000
    with gzip.open(path, "wb", compresslevel=1) as f:
        for _ in range(n // 1000):
            f.write((b"@r\n" + b"ACGT" * 25 + b"\n+\n" + b"I" * 100 + b"\n") * 1000)
    asked = []
    real = gzip.GzipFile.read
    monkeypatch.setattr(gzip.GzipFile, "read", lambda self, size=-1: (asked.append(size), real(self, size))[1])
    reader = fastx.FastxReader(str(path), 0)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == n
    assert set(asked) == {fastx.CHUNK}


def test_written_reads_come_back(spark, tmp_path):
    reads = spark.createDataFrame([(i, "ACGT" * (1 + i % 3)) for i in range(100)], "read_id long, seq string").repartition(5)
    src.write_mates(reads, 40, f"{tmp_path}/m", "fasta", "gzip")
    first, second = (src.numbered(src.read_fastx(spark, f"{tmp_path}/m_{k}")).orderBy("read_id").collect() for k in (1, 2))
    assert [r.seq for r in first + second] == ["ACGT" * (1 + i % 3) for i in range(100)]


def test_windows_are_cut_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "abc" * 7), (2, ""), (3, None), (4, "abcd" * 25), (5, "abcd" * 25 + "bb"), (6, "123")], "doc_id long, text string")
    got = {}
    for r in src.document_reads(docs).orderBy("read_id").collect():
        got.setdefault(r.read_id // src.WINDOWS, []).append(r.seq)
    assert got == {1: [("ACG" * 7 * 5)[:100]], 4: ["ACGT" * 25], 5: ["ACGT" * 25, ("ACGT" * 25 + "CC")[-100:]]}
    large = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("abcdefghij"), 500_000).alias("text"))
    began = time.time()
    assert src.document_reads(large).count() == 50_000
    assert time.time() - began < 30


def test_more_sketches_shorten_the_archive(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    reads = src.document_reads(docs).where("read_id % 3 = 0").cache()
    told = {}
    for name, sizes in (("all", sk.SCHEDULE), ("k15", (15,))):
        coded = tuple(x.cache() for x in archive.encoded(reads, sizes=sizes))
        archive.write(reads, f"{tmp_path}/{name}", False, coded=coded)
        told[name] = coded[0].agg(F.count_if(F.col("read_id") == F.col("prid")), F.sum(F.length("delta"))).first()
        assert archive.size(spark, f"{tmp_path}/{name}") > 0
    assert told["all"][0] < told["k15"][0] and told["all"][1] < told["k15"][1]


def test_each_of_six_offsets_can_be_the_shortest():
    rng = random.Random(7)
    parent = "".join(rng.choice("ACGT") for _ in range(100))
    for offset in (7, -7, 27, 13, 0, 20):
        child = "".join(rng.choice("ACGT") for _ in range(max(0, -offset))) + parent[max(0, offset) :]
        child = (child + "".join(rng.choice("ACGT") for _ in range(80)))[:80]
        shift, told = best_shift(parent, child, 7)
        assert shift == offset and decode(parent, told, shift, 80) == child
    # Both ends stick out of a shorter parent.
    shift, told = best_shift(parent[:70], "GATT" + parent[:70] + "CCCCCC", -4)
    assert (shift, told) == (-4, "GATT>CCCCCC") and decode(parent[:70], told, shift, 80) == "GATT" + parent[:70] + "CCCCCC"


def test_long_deltas_make_roots_that_take_their_trees_along(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    core = text(80)
    first = text(10) + core + text(10)
    second = first[:50] + ("A" if first[50] != "A" else "C") + first[51:]
    seqs = [core, core[:40] + ("G" if core[40] != "G" else "T") + core[41:], first, second, rc(first[3:] + text(3)), text(80), text(100)]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    coded = tuple(x.cache() for x in archive.encoded(reads, threshold=15))
    rows = coded[0].collect()
    assert all(r.read_id == r.prid or len(r.delta) < 15 for r in rows) and len(rows) == len(seqs)
    roots = {r.read_id: r.root for r in rows}
    assert all(roots[r.prid] == r.root for r in rows) and any(r.read_id != r.prid for r in rows)
    assert roots[0] != roots[2] or roots[1] != roots[3]
    archive.write(reads, f"{tmp_path}/u", True, coded=coded)
    assert sorted((r.read_id, r.seq) for r in archive.read(spark, f"{tmp_path}/u").collect()) == list(enumerate(seqs))


def rc(s):
    return s[::-1].translate(archive.COMPLEMENT)


def test_crowded_sketches_are_ordered_by_all_tasks(spark):
    rng = random.Random(1)
    rows = [(i, 15, "min", rng.choice([5, 5, 5, 6, 7 + i]), rng.randrange(2), rng.randrange(14, 20)) for i in range(300)]
    table = spark.createDataFrame(rows, "read_id long, k int, kind string, h long, strand int, pos int").repartition(7)
    plain, spread = (sorted(map(tuple, ed.cluster_index(table, ("k", "kind", "h"), hot).collect())) for hot in (10**6, 20))
    assert plain == spread and max(r[7] for r in plain) > 100


def test_two_lengths_weigh_the_larger_overhang(spark):
    core = "".join(random.Random(5).choice("ACGT") for _ in range(120))
    seqs = [core[:100], core[12:92], core[30:110], core[:80]]
    reads = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    got = {}
    for r in ed.candidates(reads, sk.minimizers(reads, 15), longest=100).collect():
        a, b = len(seqs[r.probe]), len(seqs[r.found])
        gap, rest = abs(r.s0), a - (b - abs(r.s0))
        got[r.probe, r.found] = r.dif
        assert r.how == "shift" or a == b
        assert r.dif == (gap if a == b else max(gap, rest) if rest > 0 else 100)
    assert len(got) > 2
