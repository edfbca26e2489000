import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import bpe, media, mixing, quality, toxicity, url_filter

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public.path(bpe.VOCABULARY)), public.PATTERN)


def test_perfect_hash_is_minimal(codec):
    h = codec.whole
    assert sorted(h.get(t) for t in codec.ranks) == sorted(codec.ranks.values()) and None not in h.keys
    assert h.get(b"\xff\xff\xff no token") == -1 and bpe.PerfectHash({}).get(b"a") == -1


def test_encodes_as_the_library(codec):
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(2)
    alphabet = "aB1 \n\t\r\x0b\x1c\x85\xa0 é中😀'sA٣!-_<|endoftext|>  ̈"
    cases = ["".join(r.choice(alphabet) for _ in range(r.randrange(25))) for _ in range(3000)] + ["", " ", "a" * 5000, "hello  world\n\n x ", "don't you're"]
    for t in cases:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_encode_documents(spark, codec):
    df = spark.createDataFrame([(1, "hello hello", "z"), (1, "hello hello", "z"), (None, None, "z"), (2, "", None)], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.encode_documents(df).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    n = len(codec.encode("hello hello")) // 4
    assert got == sorted([(1, n, sha(b"hello hello"))] * 2 + [(0, 0, sha(b"")), (2, 0, sha(b""))])
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_images_keep_their_payload():
    for raw in (b"", b"a", bytes(64), bytes(range(256)) * 9, b"x" * 65):
        payload = media.pad(raw)
        assert len(payload) % 64 == 0 and payload and media.decode_png(media.encode_png(payload)) == payload
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(bytes(64))[:-20] + b"broken" * 4)


def test_media_query(spark, tmp_path):
    rows = [(1, "a\0\nb <i> & c\n\nd", "c"), (2, "a", "c"), (3, "a", "c"), (4, None, None), (5, "", "c"), (6, "é" * 100_000, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, caption string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op7_media_columns(spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64) or bytes(64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.encode_png(payload)).hexdigest() and r.caption.startswith("payload ")
    assert {i: r.position for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}
    assert got[2].caption == got[3].caption and got[2].media_sha256 == got[3].media_sha256 and len(got) == 6


def test_articles_interleave_text_and_media(spark):
    texts = ["one & <b>two\nthree  four\n\nfive", "", "lone", "\nsecond", "x &amp; y\r\nz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    html = df.select("id", media.article(F.col("text"), media.payload_digest(F.col("text"))).alias("html"))
    for r in media.interleave(html, "id").collect():
        lines = [" ".join(x.split()) for x in texts[r.id].split("\n")]
        raw = texts[r.id].encode()
        said = [("text", x) for x in lines[:1] if x] + [("media", f"media:{hashlib.sha256(media.pad(raw)).hexdigest()}-{len(raw)}")] + [("text", x) for x in lines[1:] if x]
        assert [(i.kind, i.text) for i in r.sequence] == said and [i.position for i in r.sequence] == list(range(len(said)))


def test_sequences_keep_order_and_captions():
    html = "<h1>T &amp; x</h1><p>one<img src='a.png' alt='alt a'>two</p><script>no()</script><figure><img src='media:ff'><figcaption>cap</figcaption></figure><p>end"
    got = [(i["kind"], i["text"], i["caption"]) for i in media.parse_html(html)]
    assert got == [("text", "T & x", None), ("text", "one", None), ("media", "a.png", "alt a"), ("text", "two", None), ("media", "media:ff", "cap"), ("text", "end", None)]
    assert [i["position"] for i in media.parse_html(html)] == list(range(6)) and media.parse_html(None) == [] and media.parse_html(html)[4]["digest"] == "ff"


def test_broken_html_is_read_on():
    r = random.Random(1)
    for _ in range(5000):
        media.parse_html("".join(r.choice(["<", "!", "[", "-", ">", "img", " ", "src", "=", '"', "a", "/", "&", "#", "x", "]", "?", "p"]) for _ in range(r.randrange(18))))
    assert [i["text"] for i in media.parse_html("p<![=]srcimg>q<p>r")] == ["pq", "r"]


def shares(sizes, weights, total, most):
    """By brute force: fill by weight, take out what is full, begin again with the rest."""
    targets, free, rest = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], total
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in full or free:
            targets[i] = float(most * sizes[i]) if full else unit * weights[i]
        rest -= sum(targets[i] for i in full)
        free = [i for i in free if full and i not in full]
    return targets


def test_shares_stop_at_the_cap(spark):
    r = random.Random(4)
    for case in range(6):
        sizes = [r.choice([0, 1, 3, 50, 1000, 40000]) for _ in range(r.randrange(1, 30))]
        weights = [r.choice([1, 2, 3]) for _ in sizes]
        df = spark.createDataFrame(list(zip(sizes, weights)), "size long, weight int")
        level = mixing.fill_level(df, sum(sizes), 3)
        assert [float(min(3 * n, level * w)) for n, w in zip(sizes, weights)] == pytest.approx(shares(sizes, weights, sum(sizes), 3))
    assert mixing.fill_level(spark.createDataFrame([], "size long, weight int"), 0, 3) == 0


def brute_taken(rows):
    """Words that each row gives: whole rounds over its source's words in their order, then as many from the first on as are left."""
    out, sums = {}, defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.row.source_no, r.row.start, r["size"])):
        assert r.row.start == sums[r.source]  # rows lie one behind the other
        sums[r.source] += r["size"]
        rounds, left = divmod(int(r.target + 0.5), r.source_size) if r.source_size else (0, 0)
        out[(r.doc_id, r.source, r.row.start, r["size"])] = rounds * r["size"] + max(0, min(r["size"], left - r.row.start))
    return out


def mix_table(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randrange(60))), ["b", "a", None, "hot", "hot", "é"][r.randrange(6)] if i else "tiny") for i in range(600)]
    return spark.createDataFrame([*rows, (700, None, "a"), (5, "x y", "a")], "doc_id long, text string, source string")


@pytest.mark.parametrize("few", [100_000, 2])
def test_mix(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    df = mix_table(spark)
    docs, pieces, slots = mixing.mix(df)
    got = docs.collect()
    assert len(got) == 602 and all(0 <= r.taken <= 3 * r["size"] for r in got)
    sums = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        sums[r.source][0] += r["size"]
        sums[r.source][1] += r.taken
        sums[r.source][2] = r.target
        assert r.source_size == sum(x["size"] for x in got if x.source == r.source)
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    sizes = [sums[s][0] for s in names]
    assert [sums[s][2] for s in names] == pytest.approx(shares(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], sum(sizes), 3))
    for s in names:
        assert sums[s][1] == int(sums[s][2] + 0.5)
    assert {(r.doc_id, r.source, r.row.start, r["size"]): r.taken for r in got} == brute_taken(got)
    again = mixing.mix(df)[0].select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r["size"], r.taken) for r in got)
    ranks = defaultdict(list)
    for r in slots.orderBy("slot").collect():
        ranks[r.source_no].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())
    assert mixing.mix(df.limit(0))[0].collect() == []


def test_rules(spark):
    rows = ["http://A.net/x", "https://www.example.net/en/1?q", "https://example.net/de", "http://x.example.com/de/", "https://o.ORG/fr/a#b", "no url", None, "http://notexample.com", "x://net", "http://b.net?a/b", "http://a.com//net/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4] == ("o.org", "/fr/a", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow") and got[8][:3] == ("net", "", None) and got[9][:3] == ("b.net", "", None) and got[10][:2] == ("a.com", "//net/")
    assert url_filter.judge(df.limit(0)).collect() == []


def test_distrust_goes_against_links(spark):
    html = '<a href="https://bad.net/x">x</a> <a href="//bad.net/y">y</a>'
    rows = [(1, "http://bad.net/", ""), (2, "http://linker.io/", html), (3, "http://far.io/", '<a href="http://linker.io">l</a>'), (4, "http://good.org/fr/", '<a href=http://friend.io/>f</a>'), (5, "http://friend.io/", None), (6, "http://alone.io/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge(df, parent_weight=0).collect()}
    assert got[2].host_distrust > got[3].host_distrust > 0 == got[6].host_distrust and got[5].host_trust > 0
    assert [got[i].verdict for i in (1, 2, 4, 5, 6)] == ["block", "block", "allow", "allow", "allow"]
    # the same by hand
    links = {("linker.io", "bad.net"): 2.0, ("far.io", "linker.io"): 1.0, ("good.org", "friend.io"): 1.0}
    rank = {"bad.net": 1.0}
    for _ in range(url_filter.ITERATIONS):
        new = defaultdict(float, {"bad.net": 1 - url_filter.DAMPING})
        for (src, dst), w in links.items():
            new[src] += url_filter.DAMPING * rank.get(dst, 0.0) * w / sum(x for (_, d), x in links.items() if d == dst)
        rank = new
    assert got[2].host_distrust == pytest.approx(rank["linker.io"])


def labelled(spark, bad, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(400):
        said = [r.choice("the of and to in a is that for it".split()) + r.choice(["", "ing", "ed"]) for _ in range(r.randrange(20, 80))]
        y = i % 4 == 0
        if y:
            said = bad(said, r)
        rows.append((i, " ".join(said)))
        labels.append((i, int(y)))
    rows += [(1000, None), (1001, ""), (3, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, y int")


def held_out(got, folds, held):
    return [r for r in got if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % folds == held]


def test_quality_separates(spark):
    from auditlake.llm._training import labelled_sample

    docs, labels = labelled(spark, lambda w, r: [x + "&&&" for x in w], 1)
    model = quality.train(labelled_sample(docs, labels, "y", 3, 1, quality.SAMPLE))
    got = quality.score(docs, model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    held = held_out(got, 3, 1)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.97 and len(held) > 100
    assert quality.score(docs.limit(0), model).collect() == []
    assert len(quality.score(docs, quality.train(labelled_sample(docs, labels.limit(0), "y", 3, 1, 10))).collect()) == 403


def test_toxicity_separates(spark):
    from auditlake.llm._training import labelled_sample

    def bad(w, r):
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "1d1ot", "grumpf" + r.choice("abcdef"), "scum"]))
        return w

    docs, labels = labelled(spark, bad, 2)
    model = toxicity.train(labelled_sample(docs, labels, "y", 5, 0, toxicity.SAMPLE))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got)
    held = held_out(got, 5, 0)
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95 and len(held) > 60
    assert toxicity.score(docs.limit(0), model).collect() == []
    none = toxicity.train(labelled_sample(docs, labels.limit(0), "y", 5, 0, 10))
    assert len(toxicity.score(docs, none).collect()) == 403


def test_calibration_rises():
    m, rate = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(m) > 0).all() and (np.diff(rate) >= 0).all() and len(m) == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(4)
    say = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(90)) for _ in range(n))
    rows = [(i, say(40) + "\n" + "one line that many have in common", "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, f"idiot scum {say(20)} moron idiot", "en", "s1", 0) for i in range(40)]
    rows += [(200, rows[0][1].replace("common", "commons"), None, None, None), (201, None, "en", "s0", None), (202, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.materialize(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = docs.collect()
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert not any(100 <= i < 200 for i in ids("toxicity")) and ids("toxicity") >= set(range(60))
    kept = {r.doc_id: r.text for r in seen["line dedup"]}
    assert "common" in kept[0] and not any("common" in kept[i] for i in range(1, 60)) and len(kept) == 63
    assert ids("near dedup") >= set(range(60)) and len(ids("near dedup") & {201, 202}) == 1
    encoded = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(encoded) == len(seen["mixing"]) > 30
    sums = defaultdict(int)
    for x in seen["mixing"]:
        sums[x.source] += len(x.text.split())
    assert sums["s2"] > sums["s1"] > sums["s0"] > 0


def test_mix_with_sources_of_less_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 1)  # blocks of 1024 words as on large tables
    sizes = {"a": [200], "b": [700, 500], "c": [1], "d": [977] * 31, "e": [40] * 900, "f": [30, 0, 7]}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, n) for s, all_ in sizes.items() for n in all_)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()
    taken, targets = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert len(got) == len(rows) and taken == {s: int(t + 0.5) for s, t in targets.items()} and taken["a"] > 0 and taken["c"] > 0


def test_blocks_are_equal(spark):
    r = random.Random(2)
    rows = [(n := r.randrange(1, 5000), k := r.randrange(1, min(n, 60) + 1), n // k, n % k) for _ in range(60)]
    df = spark.createDataFrame(rows, "size long, n long, least long, more long")
    words = df.select("size", "n", "least", "more", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("w")).withColumn("b", mixing.block_of("w"))
    got = words.groupBy("size", "n", "b").agg(F.min("w").alias("low"), F.count("w").alias("c"), F.min(mixing.begin_of("b")).alias("begin")).collect()
    assert all(x.low == x.begin and x["c"] in (x["size"] // x.n, x["size"] // x.n + 1) and 0 <= x.b < x.n for x in got)


def test_mix_of_odd_rows(spark):
    rows = [(None, "a b c", "s", 1, "x"), (None, "a b c", "s", 2, "y"), (None, None, None, 3, "z"), (1, "", "t", 4, "w"), (2, "a " * 50000, "t", 5, "v"), (2, "a " * 50000, "t", 5, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string").withColumn("taken", F.lit("t")).withColumn("bucket", F.lit(0))
    got = mixing.mix(df)[0].collect()
    assert len(got) == 6 and sum(x.taken for x in got if x.source == "t") == int(next(x.target for x in got if x.source == "t") + 0.5) and all(0 <= x.taken <= 3 * x["size"] for x in got)


@pytest.mark.parametrize("few", [100_000, 0])
def test_distrust_is_carried_to_the_end(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "FEW_HOSTS", few)
    page = lambda host, to: (f"http://{host}/", f'<a href="http://{to}/">x</a>')
    chain = [page(f"h{i}.io", f"h{i - 1}.io") for i in range(1, 16)]
    rows = [("http://bad.net/", ""), page("h0.io", "bad.net"), *chain, page("bad.net", "h3.io")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge(df, parent_weight=0).collect()}
    # the links backwards; h3 is linked by bad.net and by h4
    back = {"bad.net": ["h0.io"], **{f"h{i - 1}.io": [f"h{i}.io"] for i in range(1, 16)}}
    back["h3.io"].append("bad.net")
    rank = {"bad.net": 1.0}
    for _ in range(400):
        new = defaultdict(float, {"bad.net": 1 - url_filter.DAMPING})
        for host, r in rank.items():
            for to in back.get(host, []):
                new[to] += url_filter.DAMPING * r / len(back[host])
        rank = new
    even = url_filter.THRESHOLD / len(rank)
    assert all(abs(got[h].host_distrust - r) <= url_filter.SMALL * even for h, r in rank.items()) and got["h15.io"].host_distrust > 0
    assert len(rank) == 17 and all((got[h].verdict == "block") == (r > even) for h, r in rank.items() if h != "bad.net")


def test_links_and_parents_by_brute_force(spark):
    """Trust and distrust with the edges between hosts and the domains above them, over pages that repeat, clash and are very long."""
    r = random.Random(8)
    hosts = ["a.net", "b.x.io", "x.io", "c.x.io", "deep.er.x.io", "good.org", "fr.good.org", "m.com", "www.m.com", "lone.dev"]
    rows = []
    for i in range(60):
        h = r.choice(hosts)
        links = " ".join(f'<a HREF="{r.choice(["http:", "https:", ""])}//{r.choice(hosts)}/p{i}">' for _ in range(r.randrange(4)))
        rows.append((i, f"http://{h}/{r.choice(['fr/', 'en/', ''])}x", links))
    rows += [rows[0], (100, "http://lone.dev/" + "y" * 200_000, "<p>" * 50_000), (101, None, None), (102, "mailto:x", '<a href="//a.net">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("host", "path", "rule", "trust", "src"):
        df = df.withColumn(c, F.lit("theirs"))
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    host_of = lambda u: u.split("://", 1)[1].split("/")[0].split("?")[0] if u and "://" in u else ""
    weight = defaultdict(float)
    for _, u, html in rows:
        for part in (html or "").split('HREF="')[1:] + (html or "").split('href="')[1:]:
            dst = part.split('"')[0].split("//", 1)[1].split("/")[0]
            if host_of(u) and dst != host_of(u):
                weight[host_of(u), dst] += 1
    named = {host_of(u) for _, u, _ in rows if host_of(u)} | {d for _, d in weight}
    ups = set()
    for h in named:
        labels = h.split(".")
        ups |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])) for i in range(len(labels) - 1)}
    for a, b in ups:
        weight[a, b] += 1
        weight[b, a] += 1
    seeds = {True: defaultdict(float), False: defaultdict(float)}
    for x in got:
        if x.rule is not None and x.host:
            seeds[x.rule in ("example.net/en/", "org/fr/")][x.host] += 1
    rank = {}
    for good, seed in seeds.items():
        edges = weight if good else {(d, s): w for (s, d), w in weight.items()}
        out = defaultdict(float)
        for (s, _), w in edges.items():
            out[s] += w
        start = {h: n / sum(seed.values()) for h, n in seed.items()}
        now = dict(start)
        for _ in range(500):
            new = defaultdict(float, {h: 0.15 * p for h, p in start.items()})
            for (s, d), w in edges.items():
                new[d] += 0.85 * now.get(s, 0.0) * w / out[s]
            now = new
        rank[good] = now
    reached = {h for now in rank.values() for h, v in now.items() if v > 0}
    even = url_filter.THRESHOLD / len(reached)
    for x in got:
        trust, distrust = rank[True].get(x.host, 0.0), rank[False].get(x.host, 0.0)
        assert abs(x.host_trust - trust) < 0.02 * even and abs(x.host_distrust - distrust) < 0.02 * even
        if x.rule is None and abs(distrust - max(trust, even)) > 0.02 * even:
            assert x.verdict == ("block" if distrust > max(trust, even) else "allow")
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Clashing columns, null, empty, long and repeated texts go through every stage; so does an empty table."""
    import corpus_pipeline as pipeline

    r = random.Random(5)
    say = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    rows = [(i, say(30), "en", f"s{i % 2}", 0) for i in range(20)]
    rows += [(None, say(30), None, None, None), (None, say(30), None, None, None), (30, None, "en", "s0", None), (31, "", "en", "s0", 0), (32, say(40000), "en", "s1", 0), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("all", "known", "a", "times", "n_removed", "size", "target", "taken", "row", "score", "label", "__text", "__score", "id", "a.b", "text.x", "back`tick"):
        docs = docs.withColumn(c, F.lit("theirs"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = none = docs
    none = none.limit(0)
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.materialize(stage(spark, now, str(tmp_path)), "odd")
        assert now.columns == docs.columns and now.where("score != 'theirs' OR n_removed != 'theirs' OR taken != 'theirs' OR known != 'theirs'").isEmpty(), name
        none = pipeline.materialize(stage(spark, none, str(tmp_path)), "none")
        assert none.isEmpty() and none.columns == docs.columns
        if name == "line dedup":
            assert now.count() == len(rows)
        if name == "near dedup":
            assert now.count() == 20 + 2 + 1 + 1 and now.where("text IS NULL OR text = ''").count() == 1
    assert pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count() > 20
    assert pipeline.STAGES[-1][1](spark, none, str(tmp_path)).isEmpty()


def test_models_take_odd_rows(spark):
    """Scores of clashing columns, very long, repeated and null texts; labels of ids that repeat."""
    from auditlake.llm._training import labelled_sample

    rows = [(i, f"plain text number {i} with words", "c") for i in range(40)] + [(1000, "word " * 60_000, "long"), (None, "x", "n"), (7, "other text of seven", "t"), (7, "other text of seven", "t"), (50, None, "z"), (51, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("label", F.lit("l")).withColumn("key", F.lit("k"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(7, 1), (None, 1)], "doc_id long, y int")
    sample = labelled_sample(docs, labels, "y", 3, 1, 1000)
    assert sample.count() == sample.select("id").distinct().count() and {x.id: x.text for x in sample.collect()}.get(7, "other text of seven") == "other text of seven"
    for module, train in ((quality, quality.train), (toxicity, toxicity.train)):
        got = module.score(docs, train(sample)).collect()
        assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
        by = defaultdict(set)
        for x in got:
            by[x.doc_id].add(round(x.score, 12))
        assert len(by[7]) <= 2 and all(len(v) == 1 for k, v in by.items() if k != 7)


def test_workers_keep_no_pre_tokens_after_a_task(spark):
    """A worker that has encoded texts keeps its codec, and nothing of the texts."""
    df = spark.createDataFrame([(i, f"some text{i} with words{i * 7}") for i in range(200)], "doc_id long, text string").repartition(4)
    assert bpe.encode_documents(df).count() == 200 and len(bpe.encode_documents(df).collect()) == 200

    def held(batches):
        import sys

        import pyarrow as pa

        own = list(sys.modules.get("_auditlake_codecs", sys).__dict__.values()) if "_auditlake_codecs" in sys.modules else []
        own = [len(c.pieces) + len(c.chunks) for c in own if type(c).__name__ == "Codec"]
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64())], ["n"])

    kept = [r.n for r in spark.range(8).repartition(8).mapInArrow(held, "n long").collect()]
    assert kept and set(kept) == {0}
