"""The training-data operators against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skerry.llm import decontaminate, line_dedup, queries
from skerry.llm.minhash import least_matches, near_duplicates
from skerry.llm.packing import best_fit, pack
from skerry.llm.quality import judge
from skerry.llm.secret_scan import VOCABULARY, Scanner, base_spans, digest, scan_secrets
from skerry.llm.sharding import assign_shards
from skerry.llm.suffix_dedup import repeated_passages
from skerry.llm.toxicity import score_toxicity
from skerry.llm.url_filter import Trie, filter_urls, split_url

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, node long, spans string, key string, shard int, n_words int"


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOW) if lower else text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    text = " ".join(f"a{i}" for i in range(80))
    rest = (None, None, None, None, None, None)
    rows = [
        (1, text, "en", "s", 1, *rest), (2, text, "en", "s", 1, *rest), (2, text, "en", "s", 1, *rest), (3, None, "en", "s", None, *rest), (4, "", None, None, 0, *rest),
        (None, text + " more", "en", "s", 1, *rest), (5, "  \n\t ", "de", None, 4, *rest), (6, long, "en", "t", 1, *rest), (7, "one", "en", "s", 3, *rest),
        (8, "l1 x\nl2 x\nl3 x\nl4 y\n\nl1 x\nl2 x\nl3 x\nzz", "en", "s", 3, *rest), (9, "l1 x\nl2 x\nl3 x", "en", "s", 3, *rest), (10, "r\nr\nr\nr\nr", "en", "s", 3, *rest),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def test_packing(docs, texts):
    out = pack(docs).toPandas()
    need = {i: len(words(t)) + 1 for i, t in texts.items()}
    assert out.groupby("doc_id").length.sum().to_dict() == {i: n if n > 1 else 0 for i, n in need.items()}
    bins = out.dropna().sort_values("position").groupby("sequence_id")
    for _, b in bins:
        assert (b.position.to_list() == [0, *np.cumsum(b.length)[:-1]]) and b.length.sum() <= b.capacity.iloc[0]
        assert not any(b.length.sum() <= c < b.capacity.iloc[0] for c in (512, 1024, 2048, 4096))
    assert best_fit([5, 4, 3], [4, 8], [4.0, 8.0]) == ([0, 1, 0], [0, 0, 5], [8, 4])


def test_packing_odd(spark, odd):
    out = pack(odd, capacities=(64, 128)).toPandas()
    assert len(out[out.sequence_id.isna()]) == 3 and out[out.doc_id == 6].length.sum() == 30_001
    assert pack(odd.limit(0)).count() == 0


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "mailto:x": ("", "", None, "allow"), "http://A.Example.NET/en/1?q": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/de": ("example.net", "/de", "net/", "block"), "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "x://example.com/de/#": ("example.com", "/de/", "example.com/de/", "block"), "x://example.net": ("example.net", "", None, "allow"), "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*cases, None])], "page_id int, url string, host string")
    want = [*cases.values(), cases[None]]
    for n in (100, 0):
        got = filter_urls(pages, queries.URL_RULES, trie_rules=n).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    assert filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_trie_against_every_rule():
    rng = random.Random(3)
    part = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "z"]) for _ in range(rng.randrange(0, 3)))
    rules = list({part() + path(): ("block", "allow")[rng.random() < 0.5] for _ in range(60)}.items())
    trie = Trie([(v, r) for r, v in rules])
    for _ in range(500):
        host, p = split_url("s://" + part() + path())
        fits = [(len(h), len(q), r, v) for r, v in rules for h, _, q in [r.partition("/")] if (host == h or host.endswith("." + h)) and p.startswith("/" + q)]
        best = max(fits, default=None)
        assert trie.match(host, p) == (best[2:] if best else None)


def brute_lines(rows):
    """doc_id and text rows to texts without later windows."""
    full = {i: [(n, x.strip(" \t\r\f\v")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\f\v")] for i, t in rows}
    first, gone = {}, collections.defaultdict(set)
    for i, _ in sorted(rows):
        for a in range(len(full[i]) - 2):
            w = tuple(x for _, x in full[i][a : a + 3])
            d, b = first.setdefault(w, (i, a))
            if (d, b) != (i, a):
                gone[i] |= {full[i][k][0] for k in range(max(a, b + 3) if d == i else a, a + 3)}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i]) for i, t in rows}


def test_line_dedup(docs, texts):
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(list(texts.items()))


def test_line_dedup_odd(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[8] == "l1 x\nl2 x\nl3 x\nl4 y\n\nzz" and got[9] == "" and got[10] == "r\nr\nr" and got[3] is None
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_decontamination_odd(spark, odd):
    items = [(1, " ".join(f"A{i}" for i in range(5, 30))), (2, "one"), (3, None), (None, "l2 X"), (4, "zz l1"), (5, "")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = decontaminate.find_contamination(odd, bench).collect()
    assert len(got) == odd.count()
    rows = collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got)
    want = collections.Counter()
    for r in odd.collect():
        w, hit, named = word.findall((r["text"] or "").translate(LOW)), set(), set()
        for item, text in items:
            v = word.findall((text or "").translate(LOW))
            n = min(13, len(v))
            for a in range(max(len(v) - n + 1, 0) if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        named |= {str(item)} - {"None"}
        want[(r["doc_id"], len(w), len(hit), tuple(sorted(named)), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert rows == want
    assert decontaminate.find_contamination(odd.limit(0), bench).count() == 0
    assert decontaminate.find_contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    named = [c[0] for c in found.description]
    want = [tuple(r[named.index(c)] for c in df.columns) for r in found.fetchall()]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_sharding(spark, docs, odd, texts):
    for df, shards in ((docs, 40), (odd, 3)):
        out = assign_shards(df, shards).toPandas()
        sizes = out.groupby("shard").slot.agg(["count", "max"])
        assert len(out) == df.count() and (sizes["max"] + 1 == sizes["count"]).all() and len(sizes) == shards
        assert sizes["count"].max() - sizes["count"].min() <= 1
        assert not out.duplicated(["shard", "slot"]).any()
    out = assign_shards(docs, 10).toPandas()
    for r in out.itertuples():
        b = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(b) + 16, zlib.crc32(b))
    groups = collections.defaultdict(set)
    for r in out.itertuples():
        groups[texts[r.doc_id]].add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    assert assign_shards(odd.limit(0)).count() == 0


def test_sharding_cuts_only_what_no_shard_can_hold(spark):
    n = 4000
    hot = lambda i: "hot" if i < n // 3 else f"pair {i // 2}" if i < 2 * n // 3 else f"only {i}"
    fours = lambda i: f"four {i // 4}" if i < n * 8 // 10 else f"only {i}"
    for text, most in ((hot, {"hot": math.ceil(n // 3 / 400)}), (fours, {})):
        df = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string")
        shards, counts = collections.defaultdict(set), collections.Counter()
        for r in assign_shards(df, 10).collect():
            shards[text(r["doc_id"])].add(r["shard"])
            counts[r["shard"]] += 1
        assert set(counts.values()) == {400}
        assert all(len(found) <= most.get(t, 1) for t, found in shards.items())


def test_secrets(spark, docs, odd, texts):
    for r in digest(scan_secrets(docs)).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    rows = [
        (1, 'é Password : "hunter22!"'), (2, "x AKIA" + "Q" * 16 + " y"), (3, "deadbeef" * 4), (4, "key q8Zr3mXv91LpTy0Bn7KwUe52 end"), (5, "token=abc"),
        (6, "123e4567-e89b-12d3-a456-426614174000"), (7, "some_long_identifier_name_2024"), (8, None), (9, ""), (9, ""), (None, "deadbeef" * 3),
    ]
    got = {(r[0], tuple((s["kind"], s["start"], s["end"]) for s in r[1])) for r in scan_secrets(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {
        (1, (("assign", 2, 22),)), (2, (("access", 2, 22),)), (3, (("hex", 0, 32),)), (4, (("random", 4, 28),)), (5, ()), (6, ()), (7, ()), (8, ()), (9, ()), (None, (("hex", 0, 24),)),
    }
    assert scan_secrets(odd).count() == odd.count() and scan_secrets(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def scanner():
    return Scanner(open(VOCABULARY, "rb").read(), 2.1, 20)


def random_spans(scanner, text):
    return [(s, e) for k, s, e in scanner.scan(text)[1] if k == "random"]


def test_secrets_of_letters_alone(scanner):
    rng = random.Random(8)
    low = "abcdefghijklmnopqrstuvwxyz"
    # in one case a few keys reach the ratio by chance
    for letters, least in ((low + low.upper(), 50), (low, 45)):
        for n in (20, 40):
            keys = ["".join(rng.choice(letters) for _ in range(n)) for _ in range(50)]
            assert sum(random_spans(scanner, f"key {key} end") == [(4, 4 + n)] for key in keys) >= least
    for t in ("the internationalization_of_documents", "Donaudampfschifffahrtsgesellschaft", "src/main/java/org/example/service", "getApplicationContextFactory"):
        assert not random_spans(scanner, t)


def test_secrets_behind_words(scanner):
    rng = random.Random(9)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    for front in ("hooks/services/notifications/", "com/services/integrations/webhooks/", "api/", "webhooks/T012/notifications_of_services="):
        for n in (24, 32):
            for _ in range(50):
                key = "".join(rng.choice(chars) for _ in range(n))
                for back in ("", "/configuration/documents"):
                    spans = random_spans(scanner, f"x {front}{key}{back} y")
                    at = 2 + len(front)
                    assert any(s <= at and at + n <= e for s, e in spans)
    for t in ("org/example/module_2024/11/25/report_of_the_department", "f0" * 10 + "/ab"):
        assert not random_spans(scanner, t)


def test_secret_prefilter_misses_nothing(texts):
    from skerry.llm._text import buffers
    import pyarrow as pa

    scanner = Scanner(open(VOCABULARY, "rb").read(), 2.1, 20)
    every = [*texts.values(), "aaaa", "0123456789ab", "cdef01234567"]  # a run over the end of a text
    data, offs = buffers(pa.array(every))
    hit = set(scanner.suspects(data, offs).tolist())
    assert all(i in hit for i, t in enumerate(every) if scanner.scan(t)[1])


def brute_passages(rows, least):
    seen, w = collections.defaultdict(list), {}
    for i, t in sorted(rows):
        w[i] = words(t)
        for s in range(len(w[i]) - least + 1):
            seen[tuple(w[i][s : s + least])].append((i, s))
    all_, later = collections.defaultdict(set), collections.defaultdict(set)
    for v in seen.values():
        for n, (i, s) in enumerate(v if len(v) > 1 else []):
            all_[i] |= set(range(s, s + least))
            later[i] |= set(range(s, s + least)) if n else set()
    return {i: (len(w[i]), len(all_[i]), len(later[i])) for i, _ in rows}


def test_suffixes(docs, texts, odd):
    got = {r["doc_id"]: (r["n_words"], r["n_repeated"], r["n_later"]) for r in repeated_passages(docs).collect()}
    assert got == brute_passages(list(texts.items()), 50)
    out = {(r["doc_id"], r["n_repeated"], r["n_later"]) for r in repeated_passages(odd).collect()}
    assert {(1, 80, 80), (2, 80, 80), (None, 80, 0), (3, 0, 0), (7, 0, 0)} <= out
    assert repeated_passages(odd.limit(0)).count() == 0


def brute_groups(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, docs, texts, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, shingle=2).collect()}
    assert got == brute_groups(list(texts.items()), 2)
    out = collections.Counter((r[0], r[2], r[3]) for r in near_duplicates(odd, shingle=2).collect())
    assert out[(1, 1, True)] == 1 and out[(2, 1, False)] == 2 and out[(None, None, True)] == 1 and out[(4, 4, True)] == 1
    assert near_duplicates(odd.limit(0)).count() == 0


def test_chains_of_near_duplicates(spark):
    """A drifting text: neighbours link, the ends don't, and a bucket's first row isn't alike to all."""
    rng = random.Random(11)
    base, rows = [f"v{rng.randrange(10**6)}" for _ in range(60)], []
    for i in range(40):
        base = base[:]
        base[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute_groups(rows, 2)


def test_sequential_test_keeps_the_threshold():
    for n in (36, 252):
        m = least_matches(n, 0.8, 1e-6)
        below = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert below < 1e-5


def test_toxicity(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta omega".split()) for _ in range(30)) + (" you vile cretin" if i % 3 == 0 else "")) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    out = score_toxicity(df, labels).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    assert ((out.predicted == 1) == (out.doc_id % 3 == 0)).all() and out.score.between(0, 1).all()
    assert score_toxicity(df.limit(0), labels).count() == 0
    assert set(score_toxicity(df, labels.limit(0)).toPandas().score) == {0.5}


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    out = score_toxicity(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    scores = collections.defaultdict(set)
    for r in out:
        scores[r["doc_id"]].add(r["score"])
    # without n-grams: the intercept, whatever the reason; equal texts score alike
    assert scores[3] == scores[4] and len(scores[3]) == 1 and scores[1] == scores[2] and len(scores[2]) == 1
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]


def brute_statistics(t):
    w = words(t, lower=False)
    n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {k for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(docs, texts, odd):
    for df in (docs, odd):
        out = judge(df).collect()
        rows = {(r["doc_id"], r["text"]) for r in df.collect()}
        assert len(out) == df.count()
        want = collections.Counter((i, brute_statistics(t)) for i, t in rows)
        got = {(r["id"], tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in out}
        assert got == set(want)
        for r in out:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
            assert (r["distance"] is None) == r["base_failed"]
        assert len({(r["id"], r["key"], r["kept"]) for r in out}) == len({(r["id"], r["key"]) for r in out})
    assert judge(odd.limit(0)).count() == 0


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(4)
    plain = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(60))
    rows = [(i, plain() if i % 50 else plain().replace(" ", " ### "), "en", "s") for i in range(400)]
    out = judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    assert set(out[~out.kept].id) == {i for i in range(400) if i % 50 == 0}


def test_pipeline(spark, docs):
    stage, kept = docs, {}
    for name, f in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in stage.collect()} if "doc_id" in stage.columns else {}
        stage = corpus_pipeline.materialise(f(spark, stage, DATA))
        if name != "packing":
            assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
        kept[name] = (before, stage)
    before, after = kept["line_dedup"]
    texts = {i: t for i, t in brute_lines(list(before.items())).items() if words(t)}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after.collect()} == {i: (t, len(t)) for i, t in texts.items()}
    before, after = kept["near_dedup"]
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in brute_groups(list(before.items()), 5).items() if i == c}
    before, after = kept["decontamination"]
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = lambda t: {tuple(w[i : i + 13]) for w in [token.findall((t or "").translate(LOW))] for i in range(len(w) - 12)}
    items = set().union(*(grams(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()))
    # no 13-word window of the benchmark is left, and no document without one has gone
    assert {r["doc_id"] for r in after.collect()} == {i for i, t in before.items() if not grams(t) & items}
    before, after = kept["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(before)
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


def test_near_dedup_tells_repeated_ids_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(5, a), (5, b), (3, b + " more"), (7, "c d e f g h"), (7, "c d e f g h"), (None, "x y z"), (None, "x y z")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    want = [(5, a), (3, b + " more"), (7, "c d e f g h"), (None, "x y z")]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_decontamination_stage_drops_long_texts_with_a_passage(spark, tmp_path):
    item = " ".join(f"i{i}" for i in range(20))
    spark.createDataFrame([(1, item), (2, "one")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = " ".join(f"p{i}" for i in range(1500))
    rows = [(1, f"{plain} {item} {plain}"), (2, plain), (3, f"{plain} one"), (4, f"{plain} {item[:40]}")]
    out = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 3, 4]


def test_stages_of_odd_rows(spark, odd, tmp_path):
    """Nulls, repeated rows, a name with a dot, and an empty table: each stage has its defined result."""
    spark.createDataFrame([(1, " ".join(f"i{i}" for i in range(20))), (2, None), (3, "")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd.withColumn("x.y", F.lit(1))
    got = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, str(tmp_path))
        got[name] = [r.asDict() for r in out.collect()]
        assert f(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
    ids = lambda name: sorted((r["doc_id"] for r in got[name]), key=lambda i: (i is None, i))
    assert ids("quality_rules") == [1, 2, 2, 6, None]  # 8 repeats itself, the others have fewer than ten words
    assert ids("line_dedup") == [1, 2, 2, 6, 7, 8, 10, None]  # without words, or emptied: 3, 4, 5, 9
    assert {r["doc_id"]: r["n_chars"] for r in got["line_dedup"]}[8] == len("l1 x\nl2 x\nl3 x\nl4 y\n\nzz")
    assert ids("near_dedup") == [1, 3, 4, 5, 6, 7, 8, 9, 10]  # 2 twice, and the one without an id, resemble 1
    assert ids("decontamination") == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]
    assert sum(r["sequence_id"] is None for r in got["packing"]) == 3 and sum(r["length"] for r in got["packing"] if r["doc_id"] == 6) == 30_001


def test_near_dedup_of_rows_without_an_id(spark):
    a = " ".join(f"a{i}" for i in range(90))
    rows = [(None, a), (None, a), (None, a + " more"), (None, None), (None, None), (None, "other words here are six now"), (3, "b c"), (3, "b c")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    got = sorted(map(tuple, out.collect()), key=repr)
    assert len(got) == 5 and got.count((None, None)) == 2 and (3, "b c") in got and sum((r[1] or "").startswith("a0") for r in got) == 1


def test_stored_tables(spark, tmp_path):
    from skerry.llm._store import discard, materialise, numbered

    stored = materialise(spark.range(1000, numPartitions=7).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("h"), F.lit(2).alias("w")))
    plain = sorted(r["n"] for r in numbered(stored, "n").collect())
    assert plain == list(range(1000))
    for by in (["g"], ["g", "h"]):
        seen = collections.defaultdict(list)
        for r in numbered(stored, "n", by).collect():
            seen[tuple(r[c] for c in by)].append(r["n"])
        assert sum(map(len, seen.values())) == 1000 and all(sorted(v) == list(range(len(v))) for v in seen.values())
    weighed = sorted(r["n"] for r in numbered(stored, "n", weight="w").collect())
    assert weighed == list(range(0, 2000, 2))
    discard(stored)
    with pytest.raises(Exception):
        stored.count()
