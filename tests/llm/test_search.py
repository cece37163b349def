"""Phrases, ranked search and the URL filter against brute force, with odd rows and empty tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlens.llm import collocations, lexical, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _pieces(text):
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOW))]


def _plain_phrases(rows, longest, least, percent, top):
    f = defaultdict(Counter)
    for lang, text in rows:
        for words in _pieces(text):
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        cands = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        found = []
        for g, a in cands.items():
            inside = [c for h, c in cands.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * c >= percent * a for c in inside):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])}
    return out


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_by_brute_force(spark, longest, monkeypatch):
    rng = np.random.default_rng(longest)
    passage = "one Two three four five six seven eight nine ten"
    rows = [("en", " ".join(rng.choice(list("abcd"), 30)) + rng.choice([".", "\n", " \t "]) + passage) for _ in range(40)]
    rows += [(None, "x y x y x y. x"), ("und", "X\tY  x y"), ("en", None), (None, ""), ("a\tb\\t\x01b", "p q p q"), ("de", "É é É é, a"), ("en", "  . ,")]
    docs = spark.createDataFrame([(k, lang, text, "clash") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, gram string")
    for least, percent, top, busy in ((2, 50, 2000, 5), (5, 90, 7, 10_000)):
        monkeypatch.setattr(collocations, "BUSY", busy)  # nodes in several parts, and none
        monkeypatch.setattr(collocations, "ENTRIES", busy // 2)
        monkeypatch.setattr(collocations, "RUN_ROWS", busy // 2)
        got = {tuple(r) for r in collocations.collocations(docs, longest=longest, min_count=least, kept_percent=percent, top=top).collect()}
        assert got == _plain_phrases(rows, longest, least, percent, top)


def test_a_node_longer_than_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RUN_ROWS", 40)
    monkeypatch.setattr(collocations, "ENTRIES", 40)
    monkeypatch.setattr(collocations, "BUSY", 10**12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 25)
    try:
        rows = [("en", f"a b w{k % 90}. a b w{k % 7}. c d w{k}") for k in range(400)] + [("en", "a b")] * 3
        docs = spark.createDataFrame(rows, "lang string, text string")
        got = {tuple(r) for r in collocations.collocations(docs, min_count=3).collect()}
        assert got == _plain_phrases(rows, 3, 3, 50, 2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_flows_and_paths(spark):
    rows = [("en", "start a b c d e f end")] * 6 + [("en", "other a b c d e g")] * 3 + [("en", "a b")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    every = collocations.graph(docs, min_count=1)
    counts = {r["gram"]: r["f"] for r in every.collect()}
    assert counts["a"] == 11 and counts["a b"] == 11 and counts["b"] == 11 and counts["d e"] == 9 and counts["end"] == 6
    edges = every.where("size = 3 and f >= 2").select("lang", "gram", "f")
    unary, places = collocations.compacted(edges, every.where("size = 2"))
    found = {(r["phrase"], r["n_edges"], r["f"]) for r in collocations.paths(edges, places).collect()}
    assert found == {("start a b", 1, 6), ("other a b", 1, 3), ("a b c d e", 3, 9), ("d e f end", 2, 6), ("d e g", 1, 3)}
    assert {r["node"] for r in unary.collect()} == {"b c", "c d", "e f"}


def test_a_long_path_and_large_counts(spark):
    text = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([("en", text)], "lang string, text string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(12))))
    every = collocations.graph(docs)
    edges = every.where("size = 3").select("lang", "gram", "f")
    _, places = collocations.compacted(edges, every.where("size = 2"))
    row = collocations.paths(edges, places).collect()
    assert [(r["phrase"], r["n_edges"], r["f"]) for r in row] == [(text, 298, 12)]
    big = 10**15  # a * a * 10**6 has 36 digits
    score = spark.range(1).select(F.expr(f"(cast({big} as decimal(16,0)) * cast({big} as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast({big} as decimal(16,0)) * cast({2 * big} as decimal(16,0)))"))
    assert score.first()[0] == 500_000


def test_phrases_of_odd_rows(odd, none):
    assert {r["phrase"] for r in collocations.collocations(odd, min_count=2).collect()} >= {"two words"}
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(none).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def _terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def _plain_ranking(docs, items, top=10):
    bags = [(i, Counter(_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                for t in set(_terms(text)) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out |= {(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores)[:top])}
    return out


def test_ranking_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)] + ["É", "ß", "naïve", "42"]
    shares = 1 / np.arange(1, len(words) + 1)
    line = lambda n: rng.choice([" ", "-", "_x", ". "]).join(rng.choice(words, n, p=shares / shares.sum()))
    docs = [(k, line(int(rng.integers(1, 60)))) for k in range(400)] + [(1000 + k, "w1 w2 W3") for k in range(40)]
    docs += [(None, "w1 w2 w3"), (2000, None), (2001, ""), (2002, " -- "), (2003, "w5 " * 3000), (7, "w1 w2")]
    items = [(k, line(12)) for k in range(15)] + [(50, None), (51, "..."), (52, "nowhere"), (53, "w1 W2 w3 w3")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items * 2], "item_id long, text string, rank int")
    want = _plain_ranking(docs, items)
    for at_once, per_cell in ((lexical.BYTES_AT_ONCE, lexical.DOCS_PER_CELL), (50, 7)):
        monkeypatch.setattr(lexical, "BYTES_AT_ONCE", at_once)
        monkeypatch.setattr(lexical, "DOCS_PER_CELL", per_cell)
        assert {tuple(r) for r in lexical.ranked(d, q).collect()} == want
    monkeypatch.setattr(lexical, "ITEM_CHARS", 300)
    assert {tuple(r) for r in lexical.ranked(d, q).collect()} == want
    text_ids = lexical.ranked(d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), q.withColumn("item_id", F.col("item_id").cast("string"))).collect()
    assert len(text_ids) == len(want) and {r["item_id"] for r in text_ids} == {str(w[0]) for w in want}


def test_cells_below_the_tenth_score_stay_closed(spark, monkeypatch):
    """Documents of one length are one stratum of several cells; cells and their bounds hold together."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.when(F.col("id") % 500 == 0, "b").otherwise("c"), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(lexical, "DOCS_PER_CELL", 100)
    vocabulary = np.unique(lexical.term_hashes(np.frombuffer(b"a b", dtype=np.uint8)))
    held = lexical.postings(docs, vocabulary)
    cells = lexical.index(held, 5000, 15000).collect()
    assert {r["m"] for r in cells} == {100} and max(len(r["doc_ids"]) for r in cells) <= 100
    assert sum(len(r["doc_ids"]) for r in cells) == 5000 and sum(r["terms"] != [] for r in cells) == len(cells)
    for r in cells:
        assert r["doc_ids"] == sorted(r["doc_ids"]) and sum(r["counts"]) == len(r["places"])


def test_ranking_of_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    assert lexical.ranked(none, bench).count() == 0 and lexical.ranked(odd, bench.limit(0)).count() == 0
    assert lexical.ranked(odd.where("text is null"), bench).count() == 0
    assert [(r["doc_id"], r["rank"]) for r in lexical.ranked(odd, bench).orderBy("rank").collect()] == [(6, 1), (6, 2), (None, 3)]


URLS = [
    "https://WWW.Example.com/en/1", "http://blog.example.com/en/2?x=1", "http://example.com/de/", "https://x.example.net/fr/1#top", "https://x.example.net/de/1",
    "http://a.net", "http://a.com", "net/es/1", "", None, "http://h.org/free-porn/1", "http://h.org/pornography", "http://h.org/pornographies", "http://h.org/casino?q=poker",
    "http://h.org/casino/casino/casino", "http://h.org/%20Casino%20POKER", "http://sex.org/a?x=://b.net/es/", "http://middlesex.org/casinos", "x://com/a", "://com", "http://u@h.net:80/es/",
    "http://h.org/\u00e9sex\u00e9/slots",
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(URLS)], "page_id int, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.judged(pages).collect()}
    rule = {k: (r["rule"], r["verdict"]) for k, r in got.items()}
    assert rule[0] == ("www.example.com/en/", "allow") and rule[1] == ("example.com/en/", "block") and rule[2] == ("com/", "allow")
    assert rule[3] == ("net/fr/", "block") and rule[4] == (None, "allow") and rule[5] == rule[6] == rule[7] == (None, "allow")
    assert rule[18] == ("com/", "allow") and rule[20] == (None, "allow")
    assert [rule[k][1] for k in (10, 11, 12, 13, 14, 15, 16, 17, 21)] == ["block", "block", "allow", "block", "allow", "block", "allow", "allow", "block"]
    assert (got[14]["soft_terms"], got[14]["hits"], got[14]["strict_terms"]) == (1, 3, 0)
    assert (got[8]["host"], got[8]["path"], got[9]["host"]) == ("", "", "") and got[16]["host"] == "sex.org" and got[3]["path"] == "/fr/1"
    kept = url_filter.without_blocked(pages)
    assert kept.columns == pages.columns and kept.count() == sum(r["verdict"] == "allow" for r in got.values())
    assert url_filter.judged(pages.limit(0)).count() == 0 and url_filter.judged(pages.select("url", F.lit("a").alias("page_id"))).count() == len(URLS)


def test_url_queries_by_sql(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id int, url string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INTEGER, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS)))
    got = {tuple(r) for r in url_filter.judged(pages).drop("hits").collect()}
    assert got == set(con.execute(url_filter.OP13_SQL).fetchall())


PARTS = st.text(st.sampled_from("abc.net/?#:-%2sex"), max_size=30)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_hosts_terms_and_rules_of_random_urls(rest):
    for url in (rest, "http://" + rest):
        host, path = url_filter.split_url(url)
        found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        assert (host, path) == ((found[1].translate(LOW), found[2]) if found else ("", ""))
        rules = (("net/", "allow"), ("a.net/s", "block"), ("net/se", "block"), ("b", "allow"))
        fits = [(r, v) for r, v in rules for h, p in [(r.partition("/")[0], r[len(r.partition("/")[0]):])]
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = url_filter.RuleBook(rules).longest(host, path)
        assert best == (max(fits, key=lambda f: (len(f[0]), len(f[0].partition("/")[0]))) if fits else None)
        counted = url_filter.TermCounter({"sex": 2, "net": 1, "a-b": 1, "se": 1}).found(url)
        for term in ("sex", "net", "a-b", "se"):
            n = len(re.findall(rf"(?=((?<![0-9a-z])|(?<=%[0-9a-f][0-9a-f])){term}(?![0-9a-z]))", url.translate(LOW)))
            assert counted.get(term, 0) == n
