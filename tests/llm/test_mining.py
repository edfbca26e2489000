import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import importance, phrases, quality_rules

COLUMNS = "doc_id long, text string, lang string, source string, rank string, score string, `a.b` string"


def brute_phrases(rows, least, most, top):
    """``rows``: (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        known = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in known.items():
            cuts = [(1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p))]
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in known.items())
            if not inside:
                left.append((min(cuts), a, " ".join(p)))
        left.sort(key=lambda x: (-x[0][0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, s[2], s[3], n[lang], s[0]) for i, (s, a, p) in enumerate(left[:top])]
    return sorted(out)


def texts(seed, n=160):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "a", "é", "É", "x y", "😀"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! ", "\r\n"]
    one = lambda: "".join(r.choice(vocabulary) + r.choice(ends) for _ in range(r.randrange(60)))
    return [(r.choice(["en", "de", None, "und"]), r.choice([None, "", " ", one(), one(), one(), "new york city of the " * 9])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_match_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, lang, "s", "x", "y", "z") for i, (lang, t) in enumerate(rows)], COLUMNS).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=4, most_words=5, top=9).collect())
    assert got == brute_phrases(rows, 4, 5, 9) and len({r[0] for r in got}) == 3


def test_shards_overlap():
    import pyarrow as pa

    r = random.Random(5)
    text = " ".join(r.choice("abc") for _ in range(400))
    whole = Counter(zip(*(text.split()[i:] for i in range(3))))

    class Every:
        value = type("All", (), {"holds": staticmethod(lambda h: np.ones(len(h), bool))})

    before = phrases.SHARD_WORDS
    for shard in (1, 2, 7, 1000):
        phrases.SHARD_WORDS = shard
        try:
            batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text])], ["lang", "text"])
            found = Counter()
            for b in phrases._counts(3, Every)([batch]):
                for p, f in zip(b.column("phrase").to_pylist(), b.column("f").to_pylist()):
                    found[tuple(p.split())] += f
        finally:
            phrases.SHARD_WORDS = before
        assert found == whole


def test_suffixes_are_sorted():
    r = random.Random(4)
    for _ in range(50):
        ids = np.array([r.randrange(3) for _ in range(r.randrange(40))], np.int64)
        run = np.arange(len(ids), 0, -1)
        order, common = phrases.suffix_array(ids, run, 5)
        said = [tuple(ids[i : i + 5]) for i in order]
        assert said == sorted(said)
        for a, b, c in zip(said, said[1:], common[1:]):
            assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_scores_beyond_64_bits(spark):
    a, n, part = 3 * 10**12, 9 * 10**13, 4 * 10**12
    known = spark.createDataFrame([("x", "p q", a, 2), ("x", "p", part, 1), ("x", "q", part + 1, 1)], "lang string, phrase string, f long, size int")
    got = phrases.scored(known, spark.createDataFrame([("x", n)], "lang string, n long")).collect()
    assert [r.score for r in got] == [1000 * a * n // (part * (part + 1))]


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None, None, None)], COLUMNS)).collect() == []


def brute_measures(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    twice = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice)


def odd_texts():
    r = random.Random(3)
    say = lambda n, v: " ".join(r.choice(v) for _ in range(n))
    out = [None, "", " \n\t", "a", "a a a", "a a a a", "é 😀 é", "x\n x\nx\n\n\nx", "#*$%&|<> #", "  \x1c \x85"]
    return out + [say(r.randrange(90), ["ab", "c", "d#", "é", "f\n"]) for _ in range(60)] + [say(3000, ["u%d" % i for i in range(60)]), say(40_000, ["v%d" % i for i in range(3000)])]


def test_measures_match_brute_force(spark):
    rows = odd_texts()
    df = spark.createDataFrame([(i, t, "x", None, "r", "s", "z") for i, t in enumerate(rows)], COLUMNS)
    got = {r.id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.measured(df).collect()}
    for i, t in enumerate(rows):
        assert got[i] == brute_measures(t), (i, t and t[:80])


def test_clashing_window_hashes(spark, monkeypatch):
    """With few bits for the hash nearly all rows take the second way."""
    real = quality_rules.F.call_function
    monkeypatch.setattr(quality_rules.F, "call_function", lambda name, *a: F.lit(-1).cast("long") * (1 << 62) if name == "shiftleft" else real(name, *a))
    rows = odd_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, text string")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), quality_rules.WHITE), lambda w: w != "")
    got = {r.id: r.n for r in df.select("id", words.alias("w")).select("id", quality_rules.repeated_words(F.col("w")).alias("n")).collect()}
    assert all(got[i] == brute_measures(t)[4] for i, t in enumerate(rows))


def test_thresholds_follow_each_group(spark):
    r = random.Random(8)
    rows = []
    for i in range(200):
        lang, source = ("en", "code") if i % 2 else ("en", None)
        words = ["word%d" % r.randrange(5000) for _ in range(80)]
        if source == "code":
            words = [w + "#" * (3 if k % 2 else 0) for k, w in enumerate(words)]
        rows.append((i, " ".join(words), lang, source))
    rows += [(900, " ".join("word%d#" % (1000 + k) for k in range(80)), "en", None), (901, " ".join("word%d#" % (1000 + k) for k in range(80)), "en", "code")]
    rows += [(902, " ".join("rare%d" % k for k in range(80)), "en", "small"), (903, " ".join("r%d#" % k for k in range(80)), None, None), (904, None, None, None), (904, None, None, None)]
    df = spark.createDataFrame([(*x, "r", "s", "z") for x in rows], COLUMNS)
    got = defaultdict(list)
    for x in quality_rules.filter_quality(df).collect():
        got[x.doc_id].append((x.base_failed, x.kept, x.reason))
    assert all(got[i] == [(False, True, "")] for i in range(200))
    # what is odd in one source is usual in the other
    assert got[900] == [(False, False, "symbols")] and got[901] == [(False, True, "")]
    assert got[902] == [(False, True, "")] and got[904] == [(True, False, "base")] * 2
    assert got[903][0][0] is False and quality_rules.filter_quality(df.limit(0)).collect() == []
    # nothing passes the base rules: nothing else is judged
    few = quality_rules.filter_quality(df.where("doc_id = 904")).collect()
    assert [(x.kept, x.reason) for x in few] == [(False, "base")] * 2


def test_sketches_merge_and_bound_quantiles(spark):
    r = random.Random(9)
    values = [int(r.lognormvariate(5, 2)) for _ in range(3000)]
    df = spark.createDataFrame([("x", "s%d" % (i % 7), 100, v, 1, 0, 1, 0) for i, v in enumerate(values)], "lang string, source string, n_words long, word_chars long, n_lines long, n_symbols long, n_dup_lines long, n_repeat_words long")
    whole = quality_rules.sketch(df.withColumn("source", F.lit("s")))
    parts = quality_rules.merge(quality_rules.sketch(df), ("lang",)).withColumn("source", F.lit("s"))
    plain = lambda s: sorted((x.rule, x.bin, x.n) for x in s.collect())
    assert plain(whole) == plain(parts)
    exact = sorted(values)
    fence = quality_rules.thresholds(whole, fence=1).first().fences.word_length
    q1, q3 = exact[len(exact) // 4], exact[3 * len(exact) // 4]
    assert abs(fence.high - (q3 + q3 - q1)) <= (2 * q3 + q1) / 32 + 8


def brute_importance(rows, target, percent, least, seed, buckets, max_n):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    sa, ta = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sa + buckets) / ((s[b] + 1) * (ta + buckets))))
    out, able = [], []
    for i, (doc_id, x) in enumerate(rows):
        f = features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(f), weight, score, None])
        if len(words(x)) >= least:
            able.append((-score, doc_id is not None, doc_id or 0, len(f), i))
    for rank, x in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[x[-1]][4] = rank + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("max_n,buckets,percent", [(1, 10_000, 10), (3, 50, 40)])
def test_importance_matches_brute_force(spark, max_n, buckets, percent):
    r = random.Random(6)
    vocabulary = ["The", "the", "É", "é", "x1", "9", "_", "😀z", "foo", "bar-baz"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, say(r.randrange(60))) for i in range(120)] + [(None, None), (None, say(30)), (5, ""), (7, "...")] + [(77, "again the same " * 9)] * 4 + [(500, say(9000))]
    target = [say(20), None, "", "foo foo foo"]
    df = spark.createDataFrame([(i, t, "x", None, "r", "s", "z") for i, t in rows], COLUMNS).repartition(3)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, max_n=max_n, buckets=buckets)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_importance(rows, target, percent, 20, "2024", buckets, max_n)


def test_importance_of_nothing(spark):
    empty, target = spark.createDataFrame([], COLUMNS), spark.createDataFrame([("a",)], "text string")
    assert importance.resample(empty, target).collect() == []
    one = importance.resample(spark.createDataFrame([(1, "a b", None, None, None, None, None)], COLUMNS), target.limit(0)).collect()
    assert [(x.n_features, x.rank) for x in one] == [(2, None)]
