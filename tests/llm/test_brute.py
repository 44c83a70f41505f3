"""The operators that SQL can't express, against slow and independent versions."""

import bisect
import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skerry.llm import quality, suffix_dedup
from skerry.llm.packing import pack
from skerry.llm.secret_scan import VOCABULARY, Scanner, scan_secrets
from skerry.llm.sharding import assign_shards, cut_links
from skerry.llm.suffix_dedup import repeated_passages
from skerry.llm.toxicity import points, score_toxicity
from skerry.llm.url_filter import filter_urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- op1
def naive_packing(lengths, sizes, costs):
    """Sorted (contents, size) of the bins that best-fit decreasing makes, by looking at every bin each time."""
    items = sorted(lengths, reverse=True)
    best = None
    for key in (lambda s: (costs[s] / s, -s), lambda s: (costs[s], s)):
        bins = []
        for n in items:
            fits = [b for b in bins if b[0] - sum(b[1]) >= n]
            if fits:
                min(fits, key=lambda b: b[0] - sum(b[1]))[1].append(n)
            else:
                bins.append((min((s for s in sizes if s >= n), key=key), [n]))
        done = sorted((sorted(b), min((costs[s], s) for s in sizes if s >= sum(b))[1]) for _, b in bins)
        total = sum(costs[s] for _, s in done)
        if best is None or total < best[0]:
            best = total, done
    return best[1]


@pytest.mark.parametrize("costs", [None, {16: 10, 32: 11, 64: 100}, {16: 1, 32: 3, 64: 5}])
def test_packing_is_best_fit(spark, costs):
    rng = random.Random(6)
    lengths = [rng.randrange(1, 60) for _ in range(300)]
    df = frame(spark, [(i, " ".join("w" * (n - 1))) for i, n in enumerate(lengths)])
    out = pack(df, capacities=(16, 32, 64), costs=costs, bucket=10_000).toPandas().dropna()
    got = sorted((sorted(b.length), int(b.capacity.iloc[0])) for _, b in out.groupby("sequence_id"))
    assert got == naive_packing([n for n in lengths if n > 1], [16, 32, 64], costs or {16: 16, 32: 32, 64: 64})


def test_packing_spreads_rows_without_an_id(spark):
    df = spark.range(6000, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    out = pack(df, bucket=500)
    sizes = [r["count"] for r in out.groupBy(F.substring_index("sequence_id", "-", 1)).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 700


# --- op2
def test_urls_by_trie_and_by_join(spark):
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "", "c"])
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "xyz"]) for _ in range(rng.randrange(0, 3)))
    rules = [(rng.choice(["block", "allow"]), rng.choice([host(), host().upper()]) + rng.choice([path(), ""])) for _ in range(80)]
    long = ".".join(f"l{i}" for i in range(1100))
    rules += [("block", long + "/"), ("block", "twice.org/"), ("allow", "twice.org/"), ("allow", "TWICE.org/")]
    urls = [f"s://{host()}{path()}?q" for _ in range(400)] + [f"s://{long}/x", f"s://m.{long}/", "s://twice.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = [sorted(map(tuple, filter_urls(pages, rules, trie_rules=n).collect())) for n in (10_000, 0)]
    assert got[0] == got[1]
    assert got[0][400][3:] == (long + "/", "block") and got[0][401][3:] == (long + "/", "block") and got[0][402][3:] == ("twice.org/", "block")


def test_many_rules_on_one_host_are_quick():
    import time

    from skerry.llm.url_filter import Trie

    trie = Trie([("block", f"a.org/p{i}") for i in range(100_000)])
    began = time.time()
    for i in range(1000):
        assert trie.match("a.org", f"/p{i}-more")[0] == f"a.org/p{i}"
    assert time.time() - began < 1


# --- op5
def test_shards_of_odd_rows(spark):
    rows = [(None, "same")] * 300 + [(i, f"t{i % 100}") for i in range(300)] + [(7, "again")] * 50 + [(None, None)] * 50
    out = assign_shards(frame(spark, rows), 7).toPandas()
    assert len(out) == 700 and (out.groupby("shard").size() == 100).all()
    assert all(sorted(g.slot) == list(range(100)) for _, g in out.groupby("shard"))


def test_cut_links(spark):
    rows = [(i, "hot" if i < 300 else f"t{i // 2}" if i < 600 else None) for i in range(900)]
    placed = assign_shards(frame(spark, rows), 9, groups=True)
    # 300 equal rows need three shards of a hundred; no pair is cut
    assert tuple(cut_links(placed).first()) == (151, 299 + 150, 2)


def test_shards_do_not_depend_on_the_partitions(spark):
    rows = [(i, f"t{i // 3}") for i in range(900)]
    a, b = (assign_shards(frame(spark, rows).repartition(n), 6, rounds=4).toPandas() for n in (1, 5))
    for out in (a, b):
        groups = out.assign(group=out.doc_id // 3).groupby("group").shard.nunique()
        assert (groups == 1).all()


# --- op6
def naive_base(text):
    """The pattern kinds, character by character."""
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    out, i = [], 0
    while i < len(text):
        low, hit = text[i:].translate(LOW), None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word):
                continue
            for quote in (1, 0):
                k = i + len(word)
                if quote and text[k : k + 1] in ("'", '"') and text[k : k + 1]:
                    k += 1
                elif quote:
                    continue
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] not in (":", "=") or not text[k : k + 1]:
                    continue
                k += 1
                while text[k : k + 1] == " ":
                    k += 1
                if text[k : k + 1] in ("'", '"') and text[k : k + 1]:
                    k += 1
                start = k
                while text[k : k + 1] in value and text[k : k + 1]:
                    k += 1
                if k > start:
                    hit = (k, k - start)
                    break
            if hit:
                break
        if hit:
            if hit[1] >= 6:
                out.append(("assign", i, hit[0]))
            i = hit[0]
        else:
            i += 1
    for kind, head, chars, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            k = i + len(head)
            while text.startswith(head, i) and text[k : k + 1] in chars and text[k : k + 1]:
                k += 1
            if text.startswith(head, i) and k > i + len(head):
                out += [(kind, i, k)] if k - i >= least else []
                i = k
            else:
                i += 1
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def secret_texts():
    rng = random.Random(12)
    parts = ["password", "Token", "api_key", "APIKEY", "secret'", '"', " ", "=", " = ", ": ", ":", "'", "é", "AKIA", "deadbeef", "0123456789abcdef", "Zz9", "\n", "hunter", "x", "_", "/"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    keys = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return texts + [f"a {''.join(rng.choice(keys) for _ in range(30))} b " * rng.randrange(1, 4) for _ in range(50)]


def test_secrets_against_a_scanner_by_characters(spark):
    texts = secret_texts()
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scan_secrets(frame(spark, list(enumerate(texts)))).collect()}
    scanner = Scanner(open(VOCABULARY, "rb").read(), 2.1, 20)
    n_random = 0
    for i, text in enumerate(texts):
        base = naive_base(text)
        assert [s for s in got[i] if s[0] != "random"] == base
        for kind, a, b in got[i]:
            if kind == "random":
                n_random += 1
                assert b - a >= 20 and (b - a) / len(scanner.encode(text[a:b])) < 2.1 and all(e <= a or b <= s for _, s, e in base)
        # every whole run of letters and digits alone that is low, free and no identifier is found
        for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9]{20,}(?![A-Za-z0-9+/_=-])", text):
            low = len(m[0]) / len(scanner.encode(m[0])) < 2.1 and len(set(m[0])) >= 8 and not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+|[A-Za-z]?[a-z]{0,18}|[A-Z]{1,19}", m[0])
            if low and all(e <= m.start() or m.end() <= s for _, s, e in base):
                assert ("random", *m.span()) in got[i]
    assert n_random > 40


def test_overlaps_take_no_quadratic_time():
    import time

    scanner = Scanner(open(VOCABULARY, "rb").read(), 2.1, 20)
    text = "password=hunter22 getApplicationContextFactoryBean2 " * 6000
    began = time.time()
    assert len(scanner.scan(text)[0]) == 6000
    assert time.time() - began < 5


# --- op7
def brute_passages(rows, least):
    seen, words = collections.defaultdict(list), {}
    for i, t in sorted(rows):
        words[i] = t.translate(LOW).split()
        for s in range(len(words[i]) - least + 1):
            seen[tuple(words[i][s : s + least])].append((i, s))
    all_, later = collections.defaultdict(set), collections.defaultdict(set)
    for places in seen.values():
        for n, (i, s) in enumerate(places if len(places) > 1 else []):
            all_[i] |= set(range(s, s + least))
            later[i] |= set(range(s, s + least)) if n else set()
    return {i: (len(words[i]), sorted(all_[i]), sorted(later[i])) for i, _ in rows}


@pytest.mark.parametrize("partitions", [1, 13])
def test_passages_with_ragged_edges(spark, partitions):
    """Shares of one passage that begin and end anywhere, loops, and one that most documents hold."""
    rng = random.Random(partitions)
    word = lambda: f"w{rng.randrange(400)}"
    long = [word() for _ in range(200)]
    hot = [word() for _ in range(45)]
    rows = []
    for i in range(220):
        a = rng.randrange(150)
        parts = [[word() for _ in range(rng.randrange(30))], long[a : a + rng.randrange(20, 90)], [word() for _ in range(rng.randrange(9))], hot if i % 3 else [], [word() for _ in range(5)]]
        if i % 20 == 0:
            parts.append(["loop", "of", "three"] * 12)
        rows.append((i, (" " if i % 2 else " \n\t").join(w.upper() if rng.random() < 0.1 else w for p in parts for w in p)))
    rows.append((500, rows[3][1]))  # a copy
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = repeated_passages(frame(spark, rows), least=30, window=12, gram=4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    inside = lambda spans: sorted({k for s in spans for k in range(s["start"], s["end"])})
    assert {r["doc_id"]: (r["n_words"], inside(r["spans"]), inside(r["later"])) for r in out} == brute_passages(rows, 30)


@pytest.mark.parametrize("cut", [False, True])
def test_a_run_of_many_neighbours_takes_little_memory(cut):
    """A passage in 3,000 places whose windows all differ: 60,000 of them, of some 350 bytes each."""
    rng = random.Random(5)
    some = lambda n: b"".join(b"w%06d " % rng.randrange(10**6) for _ in range(n))
    shared = some(31)
    run = [(some(19), shared + some(19), (True, i, b"%016d" % i, 40)) for i in range(3000)]
    out, rows = suffix_dedup._Found(), 0
    tracemalloc.start()
    try:
        for _ in suffix_dedup._resolve(run, 50, cut, out) or ():
            rows += out.taken(pa.int64()).num_rows
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows + len(out.id) == (60_000 if cut else 0)
    assert most < 15e6


# --- op9
def test_points_are_characters():
    texts = ["Aé", "", "ßZ😀", "plain"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found, at = points(data, offs)
    assert ["".join(map(chr, found[a:b])) for a, b in zip(at, at[1:])] == ["aé", "", "ßz😀", "plain"]


def test_toxicity_on_labels_held_out(spark):
    """The labels of sf0.1: 120 of 990 held-out ones are toxic, some without a sign of it in their text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, labels).filter("held_out").join(labels, "doc_id").toPandas()
    toxic, clean = out[out.toxic == 1], out[out.toxic == 0]
    assert len(toxic) > 100 and (toxic.predicted == 1).mean() >= 0.75 and (clean.predicted == 1).mean() <= 0.03
    ranks = np.argsort(np.argsort(out.score.to_numpy()))
    n1, n0 = len(toxic), len(clean)
    assert (ranks[out.toxic.to_numpy() == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.95  # area under the curve


# --- op10
def exact_mcd(x, kept, rng, starts=100):
    """The MCD of rows, from random elemental starts and exact concentration steps; (logdet, center, cov)."""
    n, p = x.shape
    h = kept * n
    floor = np.diag(np.square(quality.FLOOR))
    factor = quality.consistency(kept, p)

    def estimate(d2):
        order = np.argsort(d2, kind="stable")
        weight = np.clip(h - np.arange(n), 0, 1)  # the last one in part
        rows = x[order]
        mean = (rows * weight[:, None]).sum(0) / h
        cov = (rows * weight[:, None]).T @ rows / h - np.outer(mean, mean)
        return mean, cov * factor + floor

    best = None
    for _ in range(starts):
        some = x[rng.choice(n, p + 1, replace=False)]
        mean, cov = some.mean(0), np.cov(some.T) + floor
        last = np.inf
        for _ in range(50):
            d = x - mean
            mean, cov = estimate(np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
            det = np.linalg.slogdet(cov)[1]
            if det > last - 1e-9:
                break
            last = det
        if best is None or det < best[0]:
            best = det, mean, cov
    return best


def test_quality_against_an_exact_mcd(spark):
    rng = np.random.default_rng(3)
    n, mix = 600, rng.normal(size=(6, 6)) * 0.2
    x = rng.normal(size=(n, 6)) @ mix
    x[:120] = rng.normal(size=(120, 6)) * 0.05 + 1.5  # a fifth lies together elsewhere
    rows = spark.createDataFrame([(0, "", "", *map(float, r)) for r in x.round(6)], "level int, g_lang string, g_source string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = quality._estimate(rows, 0.75).first()
    det, mean, cov = exact_mcd(x.round(6), 0.75, rng)
    assert got["logdet"] <= det + 0.1
    ours = [np.einsum("ij,jk,ik->i", x - np.array(c), np.linalg.inv(v), x - np.array(c)) for c, v in ((got["center"], quality._full(got["cov"])), (mean, cov))]
    cut = quality.chi_square(6, 5.0)
    assert ((ours[0] > cut) == (ours[1] > cut)).all() and (ours[0][:120] > cut).all() and not (ours[0][120:] > cut).any()


def test_quality_of_every_language_and_source(spark):
    """What is usual in one source is rejected in another; a group of one row has a result."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    plain = lambda: " ".join(word() for _ in range(80))
    marked = lambda: " ".join(word() + "#" for _ in range(80))
    rows = [(i, plain(), "en", "prose") for i in range(500)] + [(1000 + i, marked(), "en", "tags") for i in range(500)]
    rows += [(5000, marked(), "en", "prose"), (5001, plain(), "en", "tags"), (6000, plain(), "xx", "one"), (6001, plain(), None, None)]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert set(out[~out.kept].id) == {5000, 5001}
    # one more estimate a group: a group of its own, measured exactly
    group = out[(out.source == "prose") & ~out.base_failed]
    assert bisect.bisect(sorted(group.distance), quality.chi_square(6, 5.0)) == 500


# --- components
def test_components_by_rounds_and_merged(spark):
    from skerry.llm.components import connected_components, merged

    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    more = [(rng.randrange(400), rng.randrange(400)) for _ in range(60)] + [(1000, 5)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")

    def brute(rows):
        root = {x: x for r in rows if r[0] != r[1] for x in r}
        for _ in root:
            for a, b in rows:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        return root

    got = lambda df: {r["node"]: r["component"] for r in df.collect()}
    parts = connected_components(table(links))
    assert got(parts) == brute(links) and got(merged(parts, table(more))) == brute(links + more)
