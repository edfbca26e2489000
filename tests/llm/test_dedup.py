import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from auditlake.llm._words import hashes, spans, windows

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(seed=1):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))
    base, passage = say(120), say(50)
    near = base.split()
    near[60] = "changed"
    out = [base, base, base.replace(" ", "\n\t "), " ".join(near), say(40) + " " + passage + " " + say(30), say(20) + " " + passage, say(200), say(3), say(3), "", None, " \n\t", "a", "a", "a b c d", "ä ö ü ß 中 文", base + "\n" + say(20) + "\n" + passage]
    out += ["same line here now\n" + say(12), "same line here now\nsame line here now", "\u2003wide\u2003space", "x" * 3000 + " " + say(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [(3, texts()[3], "x")], "doc_id long, text string, digest string")


def words(t):
    return (t or "").encode().split()


def test_hashes_follow_words_and_order():
    data = np.frombuffer(b"ab c ab\xc3\xa4 c ab", np.uint8)
    s, e, bounds = spans(data, np.array([0, 4, len(data)]))
    h = hashes(data, s, e)
    assert [bytes(data[a:b]) for a, b in zip(s, e)] == [b"ab", b"c", b"ab\xc3\xa4", b"c", b"ab"] and bounds.tolist() == [0, 2, 5]
    assert h[0] == h[4] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(set(windows(np.array([1, 2, 3, 2, 1, 2, 3], np.uint64), 3).tolist())) == 4
    assert len(windows(h, 9)) == 0


@pytest.mark.parametrize("most", [1 << 26, 20])
def test_exact_groups(spark, docs, most):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, max_filter_bytes=most).collect()}
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
    size = Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect())
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    for i, t in norm.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest())


def test_exact_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_groups(nulls).collect()) == [(0, 2, True), (0, 2, True), (7, 2, False), (7, 2, True)]


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_substrings(spark, docs, most):
    rows = docs.collect()
    starts = Counter(tuple(w[i : i + 35]) for w in map(words, (r.text for r in rows)) for i in range(len(w) - 34))
    expected = Counter()
    for r in rows:
        w = words(r.text)
        stay = [True] * len(w)
        for i in range(len(w) - 34):
            if starts[tuple(w[i : i + 35])] > 1:
                stay[i : i + 35] = [False] * 35
        kept = list(itertools.compress(w, stay))
        expected[(r.doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, max_filter_bytes=most).collect())
    assert got == expected and any(k[2] for k in got)
    assert substring_dedup.remove_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_substrings_of_many_passages(spark, most):
    """Passages that documents share in part, in full, shifted, within one text and in equal texts."""
    r = random.Random(9)
    passages = [" ".join(f"p{k}x{j}" for j in range(r.randrange(30, 160))) for k in range(8)]
    rows = []
    for i in range(120):
        parts = [" ".join(f"o{i}x{r.randrange(10**6)}" for _ in range(r.randrange(1, 50)))]
        for _ in range(r.randrange(3)):
            w = r.choice(passages).split()
            a = r.randrange(len(w))
            parts += [" ".join(w[a : a + r.randrange(10, 150)]), " ".join(f"o{i}y{r.randrange(10**6)}" for _ in range(r.randrange(9)))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[7][1]) for i in range(6)]
    starts = Counter(tuple(w[i : i + 35]) for w in (words(t) for _, t in rows) for i in range(len(w) - 34))
    expected = {}
    for i, t in rows:
        w = words(t)
        gone = {k + d for k in range(len(w) - 34) if starts[tuple(w[k : k + 35])] > 1 for d in range(35)}
        expected[i] = hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.kept_sha256 for x in substring_dedup.remove_repeats(df, max_filter_bytes=most).collect()} == expected


def expected_lines(rows, t=0.8):
    lines = sorted(((r.doc_id, i, frozenset(x.encode().split())) for r in rows for i, x in enumerate((r.text or "").split("\n"))), key=lambda x: x[:2])
    lines = [x for x in lines if x[2]]
    gone = defaultdict(set)
    for n, (i, k, s) in enumerate(lines):
        if any((j, m) != (i, k) and len(s & u) >= t * len(s | u) - 1e-9 for j, m, u in lines[:n]):
            gone[i].add(k)
    return gone


def test_lines(spark, docs):
    rows = docs.dropDuplicates().collect()
    gone = expected_lines(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for r in rows:
        kept = "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if i not in gone[r.doc_id])
        assert (got[r.doc_id].n_removed, got[r.doc_id].kept_sha256) == (len(gone[r.doc_id]), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(map(len, gone.values())) > 3
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_lines_with_many_variants(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(20)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(4)):
            own[r.randrange(20)] = f"v{r.randrange(30)}"
        rows.append((i, " ".join(own) + "\n" + " ".join(f"u{r.randrange(400)}" for _ in range(9))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = expected_lines(df.collect())
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(df).collect()} == {i: len(gone[i]) for i, _ in rows}


def test_lines_of_odd_rows(spark):
    """Null and repeated ids, clashing names, very long and repeated lines: each row comes back with its own columns."""
    head = "a header that many share"
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [
        (None, head + "\nown words of one", "k", 7), (None, head + "\nquite other text here", "l", 8), (5, head, "m", 9), (5, head, "m", 9), (5, "x y z\n" + head, "n", 10),
        (6, None, "o", 11), (7, "", "p", 12), (8, long, "q", 13), (9, long + " more", "r", 14), (10, "one\none\n\n \none", "s", 15),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, n_lines int").withColumn("row", F.lit(1)).withColumn("words", F.lit("w")).withColumn("key_a", F.lit("k"))
    got = line_dedup.dedup_lines(df, keep=df.columns)
    assert got.columns == [*df.columns, "kept_sha256"] and dict(got.dtypes)["n_removed"] == "string" and dict(got.dtypes)["n_lines"] == "int"
    texts_of = {r.n_removed: r.text for r in got.collect()}
    assert got.count() == 10 and {r.n_removed: r.n_lines for r in got.collect()} == {r[2]: r[3] for r in rows}
    # the earliest of the header is that of id 5 at line 0; its two equal rows are one document
    assert texts_of["k"] == "own words of one" and texts_of["l"] == "quite other text here" and texts_of["m"] == head and texts_of["n"] == "x y z"
    assert texts_of["o"] is None and texts_of["p"] == "" and texts_of["q"] == long and texts_of["r"] == "" and texts_of["s"] == "one\n\n "
    alone = spark.createDataFrame([(None, head + "\na b"), (None, head + "\nc d")], "doc_id long, text string")
    assert sorted(r.n_removed for r in line_dedup.dedup_lines(alone).collect()) == [0, 1]


@pytest.mark.parametrize("few", [250_000, 0])
def test_lines_with_hubs_and_pairs_of_words(spark, monkeypatch, few):
    """Small limits, so that words go through hubs and through pairs of words, and sets through a filter; nothing is lost."""
    monkeypatch.setattr(line_dedup, "FEW_SETS", few)
    monkeypatch.setattr(line_dedup, "HUB_LINES", 3)
    monkeypatch.setattr(line_dedup, "PAIR_LINES", 6)
    r = random.Random(11)
    rows = []
    for i in range(160):
        base = [f"b{r.randrange(6)}x{j}" for j in range(r.choice([2, 3, 4, 5, 9, 30, 120]))]
        base[r.randrange(len(base))] = f"v{r.randrange(9)}"
        rows.append((i, " ".join(base) + "\n" + " ".join(f"u{r.randrange(12)}" for _ in range(r.randrange(1, 8)))))
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(40) if (i + j) % 13)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = expected_lines(df.collect())
    assert {x.doc_id: x.n_removed for x in line_dedup.dedup_lines(df).collect()} == {i: len(gone[i]) for i, _ in rows}


def test_parity_bounds_the_difference():
    r = np.random.default_rng(3)
    for n, m, shared in ((10, 9, 8), (100, 110, 95), (60, 90, 50), (300, 280, 0)):
        pool = r.integers(1, 2**63, n + m - shared, dtype=np.uint64)
        x, y = pool[:n], pool[n - shared :]
        p, q = line_dedup.parity(np.concatenate([x, y]), np.array([0, n, n + m]))
        bits = lambda v: bin(int(v) & (2**64 - 1)).count("1")
        apart = bits(p[0] ^ p[1]) + bits(q[0] ^ q[1]) if min(n, m) > line_dedup.FOLDED else bits(p[0] ^ p[1] ^ q[0] ^ q[1])
        assert apart <= n + m - 2 * shared


def test_substrings_and_near_duplicates_of_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text, 1), (None, text, 2), (3, text + " z", 3), (4, None, 4)], "doc_id long, text string, key_a int").withColumn("node", F.lit("x"))
    assert sorted(((x.doc_id or 0), x.n_words, x.n_removed) for x in substring_dedup.remove_repeats(df).collect()) == [(0, 60, 60), (0, 60, 60), (3, 61, 60), (4, 0, 0)]
    near = near_dedup.near_duplicates(df).collect()
    assert sorted((x.doc_id or 0, x.class_id, x.class_size) for x in near) == [(0, 3, 3), (0, 3, 3), (3, 3, 3), (4, 4, 1)]


def expected_classes(rows, t=0.8):
    def shingles(x):
        w = words(x)
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9):
            parent[find(i)] = find(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[find(i)].append(rows[i].doc_id)
    return Counter((i, min(m), len(m)) for m in out.values() for i in m)


def test_near_duplicates(spark, docs):
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs).collect())
    assert got == expected_classes(docs.collect())
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_of_one_large_group(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(r.randrange(3)):
            own[r.randrange(100)] = f"v{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()) == expected_classes(df.collect())


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    values = r.integers(1, 2**63, 400, dtype=np.uint64)
    weight = r.random(400) + 0.5
    a, b = np.arange(0, 300), np.arange(100, 400)
    m = 1024
    s = near_dedup.signatures(np.r_[np.zeros(300, int), np.ones(300, int)], np.r_[values[a], values[b]], np.r_[weight[a], weight[b]], 2, m)
    x, y = np.zeros(400), np.zeros(400)
    x[a], y[b] = weight[a] / weight[a].sum(), weight[b] / weight[b].sum()
    both = (x > 0) & (y > 0)
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs((s[0] == s[1]).mean() - exact) < 0.06


def test_near_duplicates_with_repeated_blocks(spark):
    rows = []
    for i in range(12):
        base = " ".join(f"w{i}x{j}" for j in range(104))
        block = " ".join(f"b{i}x{j}" for j in range(21))
        # all have the same set but the first, whose set is four fifths of it
        rows += [(10 * i, base), *[(10 * i + k + 1, " ".join([base, *[block] * n])) for k, n in enumerate((1000, 20, 100))]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(df).collect()) == expected_classes(df.collect()) == Counter((i, i // 10 * 10, 4) for i, _ in rows)


def test_bands_of_equal_sets_are_all_searched():
    texts = ["a b c d e f", "a b c d e f a b c d e f a b c d e", "g h i j k", ""]
    batch = near_dedup.pa.RecordBatch.from_arrays([near_dedup.pa.array([1, 2, 3, 4]), near_dedup.pa.array(texts)], ["id", "text"])
    bands = next(near_dedup._sign(5)([batch])).column(3).to_pylist()
    assert [len(b) for b in bands] == [20, 40, 20, 20]


def test_near_duplicates_on_one_template(spark, monkeypatch):
    """Pages that have a template in common, but not 0.8 of their shingles, go through the index of rare shingles; near copies among them are found."""
    monkeypatch.setattr(near_dedup, "FEW_PAIRS", 0)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    called = []
    index = near_dedup._Search.through_index
    monkeypatch.setattr(near_dedup._Search, "through_index", lambda self, members: called.append(1) or index(self, members))
    r = random.Random(6)
    template = [f"t{j}" for j in range(150)]
    rows = []
    for i in range(40):
        own = [f"o{i}x{j}" for j in range(50)]
        rows.append((i, " ".join(template + own)))
        if i % 4 == 0:
            for k in range(3):
                copy = list(own)
                copy[r.randrange(50)] = f"c{i}x{k}"
                rows.append((100 + 10 * i + k, " ".join(template + copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((x.doc_id, x.class_id, x.class_size) for x in near_dedup.near_duplicates(df).collect()) == expected_classes(df.collect()) and called


def test_halved_parity_bounds_the_difference():
    r = np.random.default_rng(1)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64)
    bits = lambda x: (int(x) & (1 << 64) - 1).bit_count()
    for _ in range(500):
        shared = draw(r.integers(0, 40))
        x, y = (np.unique(np.concatenate([shared, draw(r.integers(1, 50))])) for _ in "xy")
        n = np.array([len(x), len(y)])
        p, _ = line_dedup.parity(np.concatenate([x, y]), np.array([0, n[0], n.sum()]))
        p = line_dedup._halved(p, n)
        assert all(0 <= v < 1 << 32 for v in p[n <= line_dedup.HALVED])
        one = int(p[0] ^ p[1]) & (1 << 64) - 1
        if n.max() <= line_dedup.FOLDED:
            assert bits((one ^ one >> 32) & 0xFFFFFFFF) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_word_counts_in_short_steps(monkeypatch):
    """Counts of a task's words are whole in whatever steps they go out, and no array of all buckets is made."""
    monkeypatch.setattr(line_dedup, "_COUNTED", 50)
    word = np.random.default_rng(2).integers(0, 1 << 47, 333, dtype=np.uint64) << np.uint64(17) >> np.uint64(3)
    word = np.concatenate([word, word[:70]])
    parts = [pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.array_split(part, 3)], pa.binary())], ["words"]) for part in np.array_split(word, 5)]
    got = Counter()
    made, zeros = [], np.zeros
    monkeypatch.setattr(np, "zeros", lambda n, *a, **k: made.append(np.prod(n)) or zeros(n, *a, **k))
    for batch in line_dedup._word_counts(parts):
        for chunk, at, n in zip(*(c.to_pylist() for c in batch.columns)):
            for a, k in zip(np.frombuffer(at, "<u2").tolist(), np.frombuffer(n, "<i4").tolist()):
                got[chunk << 16 | a] += k
    assert got == Counter((word >> np.uint64(40)).tolist()) and max(made, default=0) <= 1000


def test_lines_leave_no_shuffle_files(spark):
    """What the join shuffled is gone once its tables are written, and the setting is as before."""
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    rows = [(i, f"a b c d e{i % 7} f g h i j\nown{i} x{i} y{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before, conf = held(), spark.conf.get(line_dedup._SHUFFLES_GO)
    gone = line_dedup.removed_lines(df.select(F.col("doc_id").alias("key_a"), F.col("doc_id").alias("key_b"), F.col("doc_id").alias("id"), "text"))
    assert held() <= before and spark.conf.get(line_dedup._SHUFFLES_GO) == conf
    assert {r.key_a: list(r.lines) for r in gone.collect()} == {i: sorted(x) for i, x in expected_lines(df.collect()).items()}
