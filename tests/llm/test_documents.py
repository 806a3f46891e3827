"""Jaccard join, page extraction, quality and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from rollcall.llm import jaccard, packing, pages, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: chr(i).lower() for i in range(65, 91)}


def sets_of(rows, words):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(UPPER))
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows, words, percent):
    """Component of each row by comparing all pairs."""
    sets, up = sets_of(rows, words), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * union:
                links += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    low: dict = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return [len(s) for s in sets], [low[root(i)] if sets[i] else rows[i][0] for i in range(len(rows))], links


def corpus(seed=5, copies=70):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "ＡＢ", "\x1c", "x y"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [(i, " ".join(make(rng.choice([1, 2, 3, 5, 12, 40, 150])))) for i in range(120)]
    base = make(160)
    for i in range(copies):  # near copies of every distance, most of one bucket
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((200 + i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, " \t\r\n"), (503, rows[3][1].upper()), (504, rows[3][1] + " \x0b"), (503, rows[3][1]),
             (505, "lone"), (506, "LONE"), (507, "two words"), (508, " ".join(make(30000)))]
    rows.append((509, rows[-1][1] + " more"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_near_duplicates(spark, words, percent):
    rows = corpus()
    n, component, links = brute(rows, words, percent)
    assert links > 60
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component string")
    got = jaccard.near_duplicates(df.repartition(3), words, percent)
    want = sorted((d, s, c) for (d, _), s, c in zip(rows, n, component, strict=True))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want
    kept = [r["doc_id"] for r in jaccard.keep_one(df, words, percent).collect()]
    assert sorted(kept) == sorted({d for d, _, c in want if d == c})


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 1500)
    monkeypatch.setattr(jaccard, "FEW", 2)
    rows = corpus(6, 40)
    _, component, _ = brute(rows, 3, 90)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == sorted((d, c) for (d, _), c in zip(rows, component, strict=True))


def test_signatures_meet_whenever_similar():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(9, 400))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[int(rng.integers(0, 1 + n // 8)) :], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if jaccard.linked(common, len(a), len(b), percent) and common < max(len(a), len(b)):
                assert np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)).size


def test_unlike_sets_share_no_signature():
    # Pairs of parts that are empty had one for all sets of a band.
    rng = np.random.default_rng(2)
    for n in (20, 62, 120, 310, 740):
        found = [set(jaccard.signatures(rng.integers(0, 2**63, n).astype(np.uint64), 80).tolist()) for _ in range(150)]
        assert len(set().union(*found)) == sum(map(len, found))


@pytest.mark.parametrize("most", [1, 2, 16])
def test_sets_of_many_empty_pairs_meet(monkeypatch, most):
    monkeypatch.setattr(jaccard, "CUTS", most)
    rng, again = np.random.default_rng(3), 0
    for n in [20, 47, 59, 74, 93, 300] * 60:
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 12).astype(np.uint64)])
        assert jaccard.linked(len(a) - n // 10, len(a), len(b), 80)
        x, y = (jaccard.signatures(g, 80) for g in (a, np.sort(b)))
        assert np.intersect1d(x, y).size
        n1 = max(jaccard.first_parts(80, end)[0] for end in jaccard.bands(80, 2 * n))
        again += len(x) > 6 * n1
    assert most == 1 or again


def test_blocks_of_one_group_are_dealt_over_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "BLOCK", 100)

    def keys(percent):
        import pandas as pd

        return lambda key, rows: pd.DataFrame({"a": [key[1]], "b": [key[2]]}).astype("int64")

    monkeypatch.setattr(jaccard, "_compare", keys)
    sets = spark.createDataFrame([(i, bytes(8 * 30)) for i in range(40)], "node long, grams binary")
    members = spark.createDataFrame([(1, i) for i in range(40)], "sig long, a long")
    none = spark.createDataFrame([], "a long, b long")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = jaccard._large(members, sets, none, 80).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == len({(r["a"], r["b"]) for r in got}) == 12 * 13 // 2
    assert len({r["task"] for r in got}) > 1


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_in_the_last_bands_have_signatures(monkeypatch, percent):
    ends = jaccard.bands(percent, 400)
    grams = jaccard.mix(np.arange(1, 3 * ends[-1], dtype=np.uint64))
    edges = [n for end in ends[-3:] for n in (end, end + 1)]
    whole = {n: jaccard.signatures(grams[:n], percent) for n in edges + [2 * ends[-1]]}
    monkeypatch.setattr(jaccard, "TOP", 400, raising=False)
    for n, want in whole.items():
        monkeypatch.setattr(jaccard, "_ENDS", {})
        assert (jaccard.signatures(grams[:n], percent) == want).all()
    # After a rebuild for a larger set, the new last bands.
    monkeypatch.setattr(jaccard, "_ENDS", {})
    jaccard.signatures(grams[: 2 * ends[-1]], percent)
    for end in jaccard._ENDS[percent][-3:]:
        for n in (int(end), int(end) + 1):
            assert len(jaccard.signatures(jaccard.mix(np.arange(n, dtype=np.uint64)), percent))


def test_crowded_part_flushes_large_buckets(monkeypatch):
    large: set = set()
    x = np.array([[7, i] for i in range(20)] + [[8, 1], [8, 2], [9, 1]], np.uint64)
    rest, out = jaccard._split([x], large)
    assert {tuple(r.values()) for b in out for r in b.select(["sig", "a"]).to_pylist()} == {(7, i) for i in range(20)}
    assert large == {7} and len(rest) == 3
    _, out = jaccard._split([rest, np.array([[7, 99]], np.uint64)], large, last=True)
    assert [r for b in out for r in b.to_pylist()] == [{"sig": 7, "a": 99, "b": None}, {"sig": None, "a": 1, "b": 2}]


def test_jaccard_counts_bound_differences():
    rng = np.random.default_rng(11)
    grams = rng.integers(0, 2**63, 40_000).astype(np.uint64) * np.uint64(2)
    grams[:9_000] >>= np.uint64(14)  # cells that hold more than 255
    for n, m in ((1, 2), (500, 513), (1_024, 1_025), (3_000, 30_000), (32_768, 40_000)):
        a, b = np.unique(grams[:n]), np.unique(grams[n // 5 : n // 5 + m])
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        least = min(len(x), len(y))
        counts = jaccard.matrix([x.tobytes(), y.tobytes()], least)
        cell = [(g >> np.uint64(64 - least.bit_length() + 1)).astype(int) for g in (a, b)]
        assert (counts == [np.minimum(np.bincount(c, minlength=least), 255) for c in cell]).all()
        assert jaccard.apart(counts[:1], counts[1:])[0] <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("many", [8_000, 3])
def test_jaccard_large_buckets_fall_apart(spark, monkeypatch, many):
    """Sets that share a common passage only are not sent whole to be compared."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join([*common, *(f"w{rng.randrange(10**9)}" for _ in range(120))])) for i in range(40)]
    rows += [(100 + i, t + f" end{i}") for i, t in rows[:5]] + [(200 + i, t + f" stop{i}") for i, t in rows[:3]]
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "MANY", many, raising=False)
    sent, large = [], jaccard._large

    def spy(members, sets, links, percent):
        sent.append(sets.count())
        return large(members, sets, links, percent)

    monkeypatch.setattr(jaccard, "_large", spy)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i % 100 for i, _ in rows}
    assert sent == [13]  # those of the five groups of near copies


def test_jaccard_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, 3, 90).collect())
    assert got == [(-1, 3, None), (-1, 3, None), (1, 3, 1)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 and jaccard.keep_one(df).count() == 3


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><div class="text">{0}</div><div class="comments"><p>I agree</p></div></div><form>Sign up <input></form>
<aside>More</aside><footer>&copy; site</footer></body></html>"""


def test_elements():
    body = "<h1>Head</h1><p>One<br>two <b>bo</b>ld&nbsp;x<p>Three <a href='x>y'>link</a>.<ul><li>a<li>b</ul><!-- c --> &lt;3 &eacute"
    want = "Head One two bold x Three link. a b <3 é"
    assert pages.main_text(PAGE.format(body)) == want
    assert pages.main_text(PAGE.format(f"<article>{body}<footer>no</footer></article><p>outside</p>")) == want
    assert pages.main_text(PAGE.format("")) == pages.main_text("") == pages.main_text("<nav>x") == ""
    assert pages.main_text("plain 1 < 2 &#x41; <b>bold") == "plain 1 < 2 A bold"
    assert pages.main_text("<p class=ad>buy<p>text<div") == "text"


def test_template_finds_slot_and_furniture(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div class=top>Welcome to the site</div><div class=x><p>Share this page</p>"
             f"<p>Story {i} tells of {i * 7} things that nobody has told before, at length.</p></div><div class=y>Date {i}</div></body>", "t")
            for i in range(12)]
    rows += [(100, "http://h.example/0", rows[0][2], "t"), (101, None, "<p>no host", "t"), (102, "http://h.example/n", None, ""), (None, "http://one.example/", "<p>x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    for i in range(12):
        assert got[i] == f"Story {i} tells of {i * 7} things that nobody has told before, at length."
    assert got[100] == got[0] and got[101] == "no host" and got[102] == "" and got[None] == "x"
    assert pages.extract(df.limit(0)).count() == 0
    out = pages.extract(df).filter("page_id = 3").first()
    assert out["n_chars"] == len(out["text"]) and out["url"] == "http://h.example/3"


def test_slot_by_classes_not_tag_names(spark):
    words = lambda i, k: " ".join(f"s{i}w{j}" for j in range(k))
    card = "<article class=card><h3>Read too</h3><p>{}</p></article>"
    kinds = {  # two types of pages on one host, teasers in article elements beside both
        "a": lambda i: f"<div class=wrap><div class=story><h1>A{i}</h1><p>{words(i, 30)}</p></div>{card.format(words(i + 999, 4))}</div>",
        "b": lambda i: f"<main><section><h1>B{i}</h1><p>{words(i, 30)}</p></section></main>{card.format(words(i + 999, 4))}",
        # text in main outside the article, and articles of varying number beside text right in the body
        "m": lambda i: f"<main><p>M{i} {words(i, 14)}</p><article><p>{words(i + 50, 20)}</p></article></main>",
        "t": lambda i: f"<p>T{i} {words(i, 30)}</p>" + card.format(words(i + 999, 4)) * (1 + i % 3),
    }
    host = {"a": "two", "b": "two", "m": "m", "t": "t"}
    rows = [(f"{k}{i}", f"http://{host[k]}.example/{k}{i}", f"<html><body>{make(i)}</body></html>") for k, make in kinds.items() for i in range(12)]
    rows.append(("rare", "http://two.example/r", f"<html><body><p>outside</p><article class=x>{words(7, 9)}</article></body></html>"))
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for i in range(12):
        assert got[f"a{i}"] == f"A{i} {words(i, 30)}"
        assert got[f"b{i}"] == f"B{i} {words(i, 30)}"
        assert got[f"m{i}"] == f"M{i} {words(i, 14)} {words(i + 50, 20)}"
        assert got[f"t{i}"].startswith(f"T{i} {words(i, 30)}")
    assert got["rare"] == words(7, 9)


def junk(rng, k):
    return [" | ".join(f"c{rng.randrange(99)}" for _ in range(60)), "BUY!! " * 80, "same " * 90, "a&&& b%%% c$$$ " * 30][k % 4]


def labelled(n=600, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = " ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(120)) if good else junk(rng, i)
        docs.append((i, text, "en", "s", len(text)))
        if i % 5 < 2:
            labels.append((i, int(good), 0))
    return docs, labels, vocab


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality(spark):
    docs, labels, _ = labelled()
    extra = [(None, None, None, None, None), (9000, "", "", "", 0), (3, docs[3][1], "", "", 0), (9001, "word " * 60000, "", "", 1)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs + extra], DOCS + ", score double")
    marks = spark.createDataFrame(labels + [(77777, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(df, marks)
    rows = got.collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    by = {r["doc_id"]: r for r in rows}
    held = [(q, by[d]["predicted"]) for d, q, _ in labels if by[d]["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(100))
    # The marks of held-out rows change nothing.
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    other = quality.score_documents(df, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    assert sorted(map(str, other.collect())) == sorted(map(str, rows))
    assert quality.score_documents(df.limit(0), marks).count() == 0
    assert quality.score_documents(df, marks.limit(0)).count() == len(rows)


def test_repeated_ids_are_measured_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda good, mixed: seen.append((len(good), len(mixed))))
    rows = [(i, f"text {i}") for i in range(20)] + [(3, f"again {k}") for k in range(50)] + [(4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    quality.train(docs, marks)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(10))
    assert seen == [(10 - held, 10)]


def test_prior_is_estimated():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
        mixed = np.where(rng.random(4000) < share, good, bad)
        assert abs(quality.estimate_prior(rng.normal(2, 1, 4000), mixed) - share) < 0.1


def test_pipeline(spark, tmp_path):
    docs, labels, vocab = labelled()
    rng = random.Random(9)
    text = " ".join(rng.choice(vocab) for _ in range(150))
    docs += [(1000, text, "en", "s", 1), (1001, text + " end", "en", "s", 1), (1002, None, None, None, None), (1003, "", "en", "s", 0),
             (1004, docs[0][1] + " call 227.5.221.1", "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.classify(spark, table, str(tmp_path))
    assert kept.columns == table.columns
    scores = {r["doc_id"]: r["predicted"] for r in quality.score_documents(table, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    good = kept.collect()
    assert sorted(r["doc_id"] for r in good) == sorted(i for i, p in scores.items() if p)
    once = corpus_pipeline.deduplicate(spark, kept, str(tmp_path)).collect()
    _, component, _ = brute([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert sorted(r["doc_id"] for r in once) == sorted({c for c in component})
    masked = corpus_pipeline.pseudonymise(spark, table, str(tmp_path)).collect()
    changed = [r for r, d in zip(sorted(masked, key=lambda r: r["doc_id"]), docs, strict=True) if r["text"] != d[1]]
    assert [r["doc_id"] for r in changed] == [1004] and changed[0]["n_chars"] == len(changed[0]["text"])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in once}
    assert sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None and packing.SIZE == 4096


def test_keep_one_tells_repeated_ids_apart(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(5, a, 1), (5, b, 2), (6, b + " more", 3), (7, c, 4), (3, c + " end", 5), (7, a, 6), (8, "", 7), (8, None, 8),
            (8, "", 9), (None, a, 10), (9, c, 11), (5, b.upper(), 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    kept = sorted(r["_id"] for r in jaccard.keep_one(df.repartition(3)).collect())
    # Both texts of id 5 stay, one of the two rows with b; c's copies go for the text of id 3.
    assert [k for k in kept if k not in (2, 12)] == [1, 5, 7, 8, 9, 10] and len([k for k in kept if k in (2, 12)]) == 1
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    # Unlike texts under one id connect nothing.
    assert got == {(5, 5), (6, 5), (7, 3), (3, 3), (7, 5), (8, 8), (None, None), (9, 3)}


def test_jaccard_check_streams_and_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIRS", 2)
    grams = {i: np.arange(i, i + 100, dtype=np.uint64) for i in range(0, 30)}
    sets = spark.createDataFrame([(i, bytearray(g.tobytes())) for i, g in grams.items()], "node long, grams binary")
    pairs = [(i, j) for i in (0, 1, 7) for j in range(i + 1, 30)]
    got = sorted(tuple(r) for r in jaccard._check(spark.createDataFrame(pairs, "a long, b long"), sets, 80).collect())
    assert got == [(i, j) for i, j in pairs if 100 * (100 - j + i) >= 80 * (100 + j - i)]


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    a = " ".join(f"word{i}" for i in range(80))
    rows = [(1, f"{a} mail me at jo@example.org", 5, "n", 1, "x"), (2, f"{a} mail me at jo@example.org", 5, "n", 2, "y"),
            (3, None, None, None, 3, "z"), (4, "", 0, "", 4, ""), (None, "no id", 5, "", 5, ""), (9, "long text " * 50_000, 1, "", 6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _new string, _id int, `a.b` string")
    one = corpus_pipeline.deduplicate(spark, df, "")
    assert one.columns == df.columns and sorted(r["_id"] for r in one.collect()) == [1, 3, 4, 5, 6]
    masked = corpus_pipeline.pseudonymise(spark, one, "")
    assert masked.columns == df.columns and masked.dtypes == df.dtypes
    by = {r["_id"]: r for r in masked.collect()}
    assert by[1]["_new"] == "n" and "jo@example.org" not in by[1]["text"] and by[1]["n_chars"] == len(by[1]["text"])
    assert by[3]["text"] is None and by[1]["a.b"] == "x" and by[6]["n_chars"] == 1
    empty = corpus_pipeline.pack(spark, corpus_pipeline.pseudonymise(spark, corpus_pipeline.deduplicate(spark, df.limit(0), ""), ""), "")
    assert empty.count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, masked, "").collect()} == {1, 3, 4, None, 9}


def test_signatures_are_sent_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "HELD", 2000)
    texts = [" ".join(f"w{i * 7 % 50}x{j * (i + 3) % 301}" for j in range(40 + i)) for i in range(150)] + ["", None]
    ids = pa.array([*range(151), 151], pa.int64())
    batch = pa.record_batch([ids, pa.array(texts)], ["doc_id", "text"])
    want, most = set(), 0
    for t in texts[:150]:
        g = jaccard.shingles(t, 5)
        s = jaccard.signatures(g, 80).tolist()
        most = max(most, len(s))
        want |= {(x, jaccard.digest(g) % (1 << 64)) for x in s}
    got, sizes = set(), []
    for b in jaccard._sent(iter([batch]), 5, 80, 7):
        rows = [jaccard._decode(x) for x in b.column("rows").to_pylist()]
        for part, x in zip(b.column("part").to_pylist(), rows, strict=True):
            assert (x[:, 0] % np.uint64(7) == part).all()
            got |= set(map(tuple, x.tolist()))
        sizes.append(sum(map(len, rows)))
    assert got == want
    # No batch holds more than the bound and the signatures of one text.
    assert len(sizes) > 3 and max(sizes) <= 2000 + most
