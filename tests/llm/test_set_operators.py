"""Sharding, packing, decontamination, the Jaccard join and the pipeline, against brute force."""

import array
import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillstore.llm import bpe, decontam, ngram_join, packing, queries, sharding

NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(spark, sf_dir, name="documents"):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


# --- sharding ----------------------------------------------------------------------------------------------------


def check_shards(rows, got, shards):
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(spark, sf_dir, odd_docs, odd_rows, no_docs):
    check_shards(rows_of(spark, sf_dir), queries.op5_consistent_hash_sharding(spark, sf_dir).collect(), 16)
    check_shards(odd_rows, sharding.shard_rows(odd_docs).collect(), 16)
    check_shards(odd_rows, sharding.shard_rows(odd_docs, 7, 3).collect(), 7)
    assert sharding.shard_rows(no_docs).count() == 0
    same = spark.createDataFrame([(5, "x")] * 50, "doc_id long, text string")
    check_shards([(5, "x")] * 50, sharding.shard_rows(same).collect(), 16)


def test_shards_move_little(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_rows(docs, n).collect()} for n in (16, 17))
    assert sum(a[i] != b[i] for i in a) < 0.5 * len(a)


def test_walk_against_one_by_one():
    rnd = random.Random(6)
    for _ in range(50):
        _, owner = sharding.ring(5, 4)
        counts = {a: rnd.randint(0, 9) for a in range(20)}
        n = sum(counts.values())
        room = sharding.capacities(n, 5)
        runs = sorted(sharding.walk(counts, owner, room))
        placed = {}
        for (arc, rank, shard, slot), after in zip(runs, [*runs[1:], (None, 0, 0, 0)], strict=True):
            for r in range(rank, after[1] if after[0] == arc else counts[arc]):
                placed[arc, r] = (shard, slot + r - rank)
        assert len(placed) == n == len(set(placed.values()))
        left = list(room)
        expected = {}
        for arc in range(20):
            for r in range(counts[arc]):
                if left[owner[arc]]:
                    left[owner[arc]] -= 1
                    expected[arc, r] = owner[arc]
        for arc in range(20):
            for r in range(counts[arc]):
                if (arc, r) not in expected:
                    at = arc
                    while not left[owner[at % 20]]:
                        at += 1
                    left[owner[at % 20]] -= 1
                    expected[arc, r] = owner[at % 20]
        assert {k: v[0] for k, v in placed.items()} == expected


# --- packing -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_librarys(tokenizer, odd_rows):
    import numpy as np
    import pyarrow as pa

    from quillstore.llm import kernels

    rnd = random.Random(1)
    bits = [*"ab Z12 \n\t  .,!é ñ \u0085¿ßЖ½²_\xad", "  ", "\n\n", " the"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(5000)]
    texts += ["".join(rnd.choice([*bits, "'", " don't", "<|endoftext|>", "中", "😀"]) for _ in range(rnd.randint(0, 30))) for _ in range(1000)]
    texts += [t or "" for _, t in odd_rows] + ["word " * 60000]
    encoder = bpe.Encoder(tokenizer)
    data, offsets, _ = kernels.utf8_column(pa.array(texts))
    ids, n = encoder.encode(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t[:80]
    assert "".join(bpe.safe_cuts("one two. " * 50000)) == "one two. " * 50000


def test_best_fit_decreasing_against_one_by_one():
    rnd = random.Random(2)
    for _ in range(200):
        w = rnd.choice([8, 16, 37, 64])
        lengths = [rnd.randint(1, w) for _ in range(rnd.randint(0, 60))]
        histogram = collections.Counter(lengths)
        bins: list = []
        for x in sorted(lengths, reverse=True):
            best = min((i for i in range(len(bins)) if bins[i] + x <= w), key=lambda i: w - bins[i], default=None)
            if best is None:
                bins.append(x)
            else:
                bins[best] += x
        by, windows = collections.defaultdict(list), collections.defaultdict(list)
        for p in packing.best_fit_decreasing(dict(histogram), w):
            by[p[0]].append(p)
        for x, n in histogram.items():
            for r in range(n):
                _, rank, per, first, offset = max(p for p in by[x] if p[1] <= r)
                windows[first + (r - rank) // per].append((offset + (r - rank) % per * x, x))
        assert sorted(windows) == list(range(len(windows)))
        for v in windows.values():
            v.sort()
            assert [a for a, _ in v] == [sum(x for _, x in v[:i]) for i in range(len(v))]
        assert sorted(bins) == sorted(sum(x for _, x in v) for v in windows.values())


def check_pieces(rows, got, tokenizer, window=1024):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    expected = collections.Counter()
    total = 0
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for a in range(0, len(ids), window):
            part = ids[a : a + window]
            expected[i, a, len(part), zlib.crc32(array.array("I", part).tobytes()), len(ids)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expected
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    for v in windows.values():
        v.sort()
        assert [a for a, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= window
    assert sorted(windows) == list(range(len(windows)))
    return total / max(1, window * len(windows))


def test_packing(spark, sf_dir, odd_docs, odd_rows, no_docs, tokenizer):
    assert check_pieces(rows_of(spark, sf_dir), queries.op7_best_fit_packing(spark, sf_dir).collect(), tokenizer) > 0.97
    got = packing.pack(odd_docs, tokenizer, with_ids=True).collect()
    check_pieces(odd_rows, got, tokenizer)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    check_pieces(odd_rows, packing.pack(odd_docs, tokenizer, window=16).collect(), tokenizer, 16)
    assert packing.pack(no_docs, tokenizer).count() == 0


# --- decontamination ---------------------------------------------------------------------------------------------


def brute_decontamination(rows, items, window=13):
    wanted = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wanted[tuple(w[a : a + window])].add(str(i))
    sizes = {len(k) for k in wanted}
    out = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if owners := wanted.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= owners
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def digests(df):
    return sorted(map(tuple, decontam.digest(df).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_decontamination_query(spark, sf_dir):
    got = queries.op8_benchmark_decontamination(spark, sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == brute_decontamination(rows_of(spark, sf_dir), items)


@pytest.mark.parametrize("block_bytes", [8 << 20, 1500])
def test_decontamination_odd_rows(spark, odd_docs, odd_rows, no_docs, block_bytes):
    long = [t for _, t in odd_rows if t and len(t.split()) > 25]
    items = [(1, long[0]), (2, " ".join(long[1].split()[3:20])), (3, "a b"), (4, None), (5, ""), (6, " ".join(long[2].split()[:13]).upper()), (7, long[0]), (None, long[3]), (10, "a"), (2, long[4]), (7, long[0]), (None, long[5])]
    df = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    items = [("null" if i is None else i, t) for i, t in items]
    assert digests(decontam.decontaminate(odd_docs, df, block_bytes=block_bytes)) == brute_decontamination(odd_rows, items)
    assert decontam.decontaminate(no_docs, df).count() == 0
    assert decontam.digest(decontam.decontaminate(odd_docs, df.where("false"))).where("contaminated or n_items > 0").count() == 0
    kept = decontam.drop_contaminated(odd_docs, df, block_bytes=block_bytes)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r[-1] for r in brute_decontamination(odd_rows, items))


def test_proximity(spark):
    words = [f"w{i}" for i in range(13)]
    near = [*words[:5], "extra", *words[5:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1])), (4, " ".join(words[:7] + ["x"] * 9 + words[7:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.items, r.near_items) for r in decontam.decontaminate(docs, items, slack=3).collect()}
    assert got == {1: (["9"], []), 2: ([], ["9"]), 3: ([], []), 4: ([], [])}


# --- Jaccard join ------------------------------------------------------------------------------------------------


def shingles(t, k):
    w = NOT_SPACE.findall(lower(t))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_join(rows, o):
    sets = [shingles(t, o.k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    classes = collections.defaultdict(list)
    for i, s in enumerate(sets):
        if s:
            classes[s].append(i)
    for v in classes.values():
        for x in v:
            parent[root(x)] = root(v[0])
    reps, links = [v[0] for v in classes.values()], 0
    for x in range(len(reps)):
        for y in range(x):
            a, b = sets[reps[x]], sets[reps[y]]
            n = len(a & b)
            if o.den * n >= o.num * (len(a) + len(b) - n):
                links += 1
                parent[root(reps[x])] = root(reps[y])
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr), links, len({root(i) for i in range(len(rows))})


OPTIONS = [ngram_join.Options(), ngram_join.Options(k=5, num=80), ngram_join.Options(k=2, num=70, hit_rate=0.3, verify_cost=100, compare_cost=1e4)]


@pytest.mark.parametrize("o", OPTIONS, ids=["3-90", "5-80", "2-70"])
def test_join_odd_rows(spark, odd_docs, odd_rows, o):
    expected, links, groups = brute_join(odd_rows, o)
    joined = ngram_join.jaccard_join(odd_docs, o, all_links=True)
    got = ngram_join.component_rows(joined)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == expected
    assert joined.links.distinct().count() == links
    kept = ngram_join.one_per_component(odd_docs, o)
    assert kept.columns == odd_docs.columns and kept.count() == groups


def test_join_query_and_empty(spark, sf_dir, no_docs):
    expected, _, _ = brute_join(rows_of(spark, sf_dir), OPTIONS[0])
    got = queries.op9_ngram_jaccard_join(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected
    assert ngram_join.component_rows(ngram_join.jaccard_join(no_docs)).count() == 0
    assert ngram_join.one_per_component(no_docs).count() == 0


def test_packed_signatures_are_small():
    """What the join shuffles per signature and per allowed difference; steps that four bytes do not hold come back too."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    for n, most in ((ngram_join.HELD, 5), (5, 100), (1, 1000)):
        sig = np.sort(rnd.integers(0, 1 << 48, n).astype(np.uint64))
        sig[-1] = sig[max(0, n - 2)]  # one comes twice
        batch = ngram_join._pack(sig, None, 7)
        assert (ngram_join._unpack(pa.Table.from_batches([batch])) == sig).all()
        assert batch.nbytes <= most * n
    for o in OPTIONS:
        assert all(64 * ngram_join.sketch_words(n, o) <= max(64, 8 * ngram_join.difference(2 * n, o)) for n in range(1, 5000))


def test_a_large_group_of_copies(spark):
    """Near copies of one text, some too far from all others, and a passage that many texts share."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        w = list(base)
        for _ in range(rnd.randint(1, 7)):
            w[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + [f"y{i}_{j}" for j in range(50)])) for i in range(60)]
    expected, _, _ = brute_join(rows, OPTIONS[0])
    got = ngram_join.component_rows(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected


def test_near_copies_around_a_stranger(spark):
    """2000 near copies whose hub is none of them: what comparisons give back does not grow with the pairs."""
    import numpy as np
    import pyarrow as pa

    o, rnd = ngram_join.Options(block_bytes=1 << 20), np.random.default_rng(5)
    base = np.sort(rnd.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([rnd.choice(base, 294, replace=False), rnd.integers(0, 1 << 62, 6).astype(np.uint64)])) for _ in range(2000)]
    sets.append(np.unique(rnd.integers(0, 1 << 62, 300).astype(np.uint64)))  # the stranger
    rows = [(7, i, len(x), i, ngram_join.sketch(x, ngram_join.sketch_words(len(x), o)).tolist(), i == 2000) for i, x in enumerate(sets)]
    around = spark.createDataFrame(rows, ngram_join.AROUND).repartition(4).cache()
    elements = spark.createDataFrame(pa.table({"row": np.arange(len(sets)), "elements": [x.tobytes() for x in sets]}))
    give = lambda some: elements.join(some, "row", "left_semi")
    assert ngram_join.linked(around, ngram_join.deal_star, give, o).count() == 0
    links = ngram_join.linked(around.where("not centre"), ngram_join.deal_across, give, o)
    dealt = ngram_join.deal_across(around.where("not centre"), 8 * F.col("n") + 8 * F.size("sketch") + 64, o.block_bytes)
    assert dealt.select("task").distinct().count() > 1 and links.count() < dealt.count()
    at_once = {(a, b) for a, b in links.collect()}
    assert all(10 * len(np.intersect1d(sets[a], sets[b])) >= 9 * len(np.union1d(sets[a], sets[b])) for a, b in at_once)
    roots = ngram_join.components(links).select("root").distinct().count()
    full = {(i, j) for i in range(0, 2000, 397) for j in range(2000) if i != j and 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))}
    root_of = {r.row: r.root for r in ngram_join.components(links).collect()}
    assert full and all(root_of[i] == root_of[j] for i, j in full) and 1 <= roots < 2000
    # Once the copies are one root, their blocks are not paired with each other.
    one = around.where("not centre").withColumn("root", F.when(F.col("row") < 1990, 0).otherwise(F.col("row")))
    assert ngram_join.deal_across(one, F.lit(4096), o.block_bytes).count() < 3 * 2000


def test_hot_keys_are_joined_apart(spark):
    from quillstore.llm.common import broadcast_hot, maybe_among

    left = spark.range(5000).select((F.col("id") % 3 * F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("k <> 2")
    total, most = right.agg(F.sum("size"), F.max("size")).first()
    for how in ("inner", "left"):
        a, b = (sorted(map(tuple, x.select("k", "id", "size").collect()), key=repr) for x in (broadcast_hot(left, right, ["k"], "size", total, most, how), left.join(right, "k", how)))
        assert a == b
    keys = left.where("id < 40").select(F.xxhash64("id").alias("h"))
    some, others = maybe_among(left, F.xxhash64("id"), keys, 40, rest=True)
    assert some.where("id < 40").count() == 40 and some.count() < 60 and some.count() + others.count() == 5000
    assert maybe_among(left, F.xxhash64("id"), keys.where("false"), 0).count() == 0


def test_chains_are_followed(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)], "a long, b long")
    got = {r.row: r.root for r in ngram_join.components(links).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 150: 100}


# --- pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, tokenizer, odd_docs, no_docs):
    import public_tokenizers  # noqa: F401

    import corpus_pipeline as C
    from quillstore.llm import compression

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    with_letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    good = {r.doc_id for r in compression.compression_bands(docs).where("kept").collect()}
    rows = [r for r in with_letters if r[0] in good]
    groups, _, _ = brute_join(rows, OPTIONS[1])
    first = {c for _, n, c in groups if n} | {i for i, n, _ in groups if not n}
    rows = [r for r in rows if r[0] in first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute_decontamination(rows, items) if not r[-1]}
    check_pieces([r for r in rows if r[0] in clean], C.run(spark, sf_dir).collect(), tokenizer)
    odd = [(r.doc_id, r.text) for r in odd_docs.collect()]
    kept = {
        "language ID": sum(any(c.isalpha() for c in t or "") for _, t in odd),
        "quality rules": compression.compression_bands(odd_docs).where("kept").count(),
        "n-gram Jaccard join": brute_join(odd, OPTIONS[1])[2],
        "benchmark decontamination": len(odd),
    }
    for name, stage in C.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        assert stage(spark, no_docs, sf_dir).count() == 0
        if name == "packing":
            check_pieces(odd, out.collect(), tokenizer)
        else:
            assert out.columns == odd_docs.columns and out.count() == kept[name]


def test_queries_with_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf_dir)
        want = con.execute(sql)
        names = sorted(d[0] for d in want.description)
        at = [[d[0] for d in want.description].index(c) for c in names]
        assert sorted(got.columns) == names
        assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall()), name
