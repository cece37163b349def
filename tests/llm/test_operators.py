"""Odd rows, empty tables, exact round trips and brute force for the corpus operators."""

import io
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from gridlens.llm import chat, decontaminate, fingerprint, html_text, jaccard, mixing, tokens, toxicity, warc
from gridlens.llm.queries import QUERIES, SQL
from gridlens.llm.shared import scratch, table


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), connect(folder), SQL[name]) == []


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["copies"] <= 3 for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix(none).count() == 0
    assert sorted(map(str, mixing.mix(odd).collect())) == sorted(map(str, rows))


def _plain_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sets, group


def test_components_by_brute_force(spark, folder, odd, none):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, group = _plain_components(rows)
    least = {g: min(i for (i, _), h in zip(rows, group) if h == g) for g in group}
    want = sorted((i, len(s), least[g]) for (i, _), s, g in zip(rows, sets, group))
    assert sorted(tuple(r) for r in QUERIES["op10_jaccard"](spark, folder).collect()) == want
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.components(odd).collect()}
    assert got >= {(1, 1), (2, 1), (10, 1), (3, 3), (4, 4), (5, 5), (6, 6), (None, 6)}
    kept = jaccard.without_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 8, 9]
    assert jaccard.components(none).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(500):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(1, 40), dtype=np.uint64)]))
        bits = [np.frombuffer(jaccard.parity_bits(x), dtype=np.uint64) for x in (a, b)]
        if jaccard.linked(a, b, 75):
            assert jaccard.may_link(len(a), bits[0], len(b), bits[1], 75)


def test_leaks(spark, odd, none):
    item = " ".join(f"item{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    near = item.replace("item15", "other")
    more = spark.createDataFrame([(20, "a b " + item.upper() + " c"), (21, near + " tail"), (22, " ".join(item.split()[:12]))], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(20, 1), (6, 2), (None, 2)}  # one changed word in 30 leaves 21 of 31 shingles
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 21, 22]
    assert decontaminate.without_leaks(none, bench).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_weighted_overlap(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(sorted(rng.integers(0, top, rng.integers(0, 30)).tolist()) for _ in "ab") for top in (3, 10, 100) for _ in range(60)]
    want = [sum(min(a.count(x), b.count(x)) for x in set(a)) for a, b in rows]
    common, total = decontaminate.similarity(F.col("a"), F.col("b"))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(common.alias("n"), total.alias("t")).collect()
    assert [tuple(r) for r in got] == [(n, len(a) + len(b) - n) for n, (a, b) in zip(want, rows)]


def test_long_items_are_checked_in_time(spark):
    import time

    words = [f"w{k}" for k in range(1200)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(words) + " after"), (2, " ".join(words[::-1]))], "doc_id long, text string")
    begun = time.time()
    assert [(r["doc_id"], r["similarity"], r["word_start"]) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1.0, 1)]
    assert time.time() - begun < 60  # 82 s when every hash was counted by scanning both lists


NAMES = ["_hash", "_src", "_id", "_tie", "_class", "_range", "_rank", "_copy", "b_src", "copies", "key_1", "KEY_2", "places", "_i", "_h", "_ah", "row", "digest", "c0", "c1", "_score", "component", "item_id", "Size"]


def test_names_of_columns_do_not_clash(spark, folder):
    import corpus_pipeline

    rows = [(str(k), "one two three four five six seven" if k < 4 else f"text {k} of its own with some words", "ab"[k % 2], *[f"{k}"] * len(NAMES)) for k in range(8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    bench = spark.createDataFrame([("x", "TEXT 5 of its own with some words")], "item_id string, text string")
    assert {tuple(r) for r in mixing.mixed(docs).collect()} <= set(rows)
    taken = mixing.mix(docs)
    assert taken.count() == 8 and {r["size"] for r in taken.collect()} == {7, 8}
    found = decontaminate.contaminated(docs, bench)
    assert [(r["doc_id"], r["item_id"], r["key_1"]) for r in found.collect()] == [("5", "x", "5")]
    assert {tuple(r) for r in decontaminate.without_leaks(docs, bench).collect()} == {r for r in rows if r[0] != "5"}
    assert {tuple(r) for r in jaccard.without_near_copies(docs).collect()} == {rows[0], *rows[4:]}
    assert {tuple(r) for r in corpus_pipeline.reject_toxic(spark, docs, folder).collect()} <= set(rows)


def test_fingerprints_by_brute_force(spark, folder, odd, none):
    cut = lambda t: {p for p in re.split(r"\n+|(?<=[.!?]) +", t) if p}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").orderBy(F.desc("doc_id")).select("doc_id", "text").collect()]
    want = []
    for k, (i, text) in enumerate(rows):
        other, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        want.append((i, len(text), round(like(cut(text), cut(edited)), 9), round(like(cut(text), cut(other)), 9)))
    got = QUERIES["op5_fingerprints"](spark, folder).orderBy(F.desc("doc_id")).collect()
    assert [(r["doc_id"], r["n_chars"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got] == want
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(none).count() == 0


def test_token_files(spark, folder, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_bpe_path())
    for docs in (table(spark, folder, "documents").select("doc_id", "text"), odd.select("doc_id", "text"), none):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r))
        start, want = 0, []
        for i, text in rows:
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = [tuple(r) for r in tokens.token_digests(tokens.encoded(docs)).orderBy("start").collect()]
        assert got == want


def test_pieces_encode_like_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.word_bpe_path())
    texts = [
        "A,b. C.. ΟΔΟΣ, ΣΑΣ. İstanbul, I'll don't. x.y, <|endoftext|> <|ENDOFTEXT|>, ..., é́, 12, a1, \t tab nb,",
        "É. é. Straße, ŉ. ﬁ,", None, "", "  ", "a\n\nb### c.\ndef,\n", "<|x a.|> b.", "… abc…. abc.… 5. ٣. 五.", "क़क. xक़", "a\u0338. a.\u0338 \u0338",
        "각. ᄀ ᅡ", "ab.'s ab.' s it's'. 's", "x" * 5000, "a\x0bb\x0cc. d\u0085e.\u2003f",
    ]
    for limit in (tokens.CACHED_WORDS, 3):
        monkeypatch.setattr(tokens, "CACHED_WORDS", limit)
        encoder = tokens.PieceEncoder(tokens.word_bpe_path())
        for _ in range(2):
            ids, bounds = encoder.batch(pa.array(texts, pa.string()), 1)
            got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
            assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert [len(x) for x in encoder.batch(pa.array([], pa.string()), 1)] == [0, 1]


def test_length_report(spark, folder, odd, none):
    encoding = tokens._byte_bpe(tokens.byte_bpe_path())
    for docs in (table(spark, folder, "documents"), odd):
        sizes = [len(encoding.encode_ordinary(r["text"] or "")) for r in docs.select("text").collect()]
        got = tokens.length_report(tokens.length_histogram(docs)).collect()
        assert {r["context_limit"] for r in got} == set(sizes)
        for r in got:
            limit = r["context_limit"]
            assert (r["n_docs"], r["docs_over"], r["tokens_over"]) == (sizes.count(limit), sum(s > limit for s in sizes), sum(s for s in sizes if s > limit))
            assert r["truncated_total"] == sum(min(s, limit) for s in sizes) and r["total_tokens"] == sum(sizes)
    assert tokens.length_report(tokens.length_histogram(none)).count() == 0


def test_toxicity(spark, odd, none):
    clean = [f"the plain text number {i} says nothing of note about thing{i % 7}" for i in range(200)]
    bad = [f"the plain text number {i} says you {w} about thing{i % 7}" for i, w in enumerate(["grobblex", "grobblen", "grobblet", "grobbled"] * 50)]
    model = toxicity.fit([t for pair in zip(clean, bad) for t in pair], [0, 1] * 200)
    found = toxicity.Scorer(model).score(["a fine day", "you grobblez here", "", None])
    assert found[0] < 0.3 <= found[1] and found[2] == found[3] < 0.3
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit([], []).bias == 0


def test_packages(spark):
    pages = spark.createDataFrame([(1, "u1", "<p>a"), (2, None, "<p>a"), (3, "u\n3", None), (4, "u4", ""), (5, "u5", "é" * 70_000), (None, "u6", "<p>a"), (2, None, "<p>a")], "page_id long, url string, html string")
    manifest = warc.write_packages(pages, scratch(spark, "warc"), package_bytes=200)
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_packages(manifest).collect())
    assert got == sorted([(1, "response", None, 4), (2, "revisit", 1, 4), (2, "revisit", 1, 4), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 140_000), (0, "revisit", 1, 4)])
    path = manifest.first()["package"].removeprefix("file:")
    with zipfile.ZipFile(path) as package:  # another reader accepts the file
        assert package.testzip() is None and package.namelist() == [warc.ARCHIVE, warc.INDEX]
    plain = io.BytesIO()
    with zipfile.ZipFile(plain, "w") as package:
        package.writestr("a/b", b"data")
    archive = warc.Archive(plain, len(plain.getvalue()))  # 32-bit directory
    assert archive.read(archive.start("a/b"), 4) == b"data"
    assert warc.read_packages(warc.write_packages(pages.limit(0), scratch(spark, "warc"))).count() == 0


@pytest.mark.parametrize("kind,ids", [("string", ["b", " a\n%:", "", "é"]), ("date", ["2020-01-02", "2019-01-01", None, "2021-01-01"]), ("decimal(20,2)", ["10.50", "9.25", "9.25", None])])
def test_packages_of_any_id(spark, kind, ids):
    rows = [(x, "<p>same" if k < 3 else "<p>" + "long " * 50_000, 1) for k, x in enumerate(ids)]
    pages = spark.createDataFrame(rows, "i string, html string, _sha int").selectExpr(f"cast(i as {kind}) as page_id", "'u' as url", "html", "_sha")
    found = warc.read_packages(warc.write_packages(pages, scratch(spark, "warc"), package_bytes=300), kind, bytes_per_read=100, bytes_per_batch=1)
    assert found.schema["page_id"].dataType == pages.schema["page_id"].dataType
    got = found.selectExpr("cast(page_id as string) as p", "cast(refers_to as string) as r", "payload_digest as d", "cast(payload as string) as t").collect()
    least = pages.where("html = '<p>same'").selectExpr("cast(min(page_id) as string) as p").first()["p"]
    want = [(x, None if x == least or len(h) > 10 else least, warc.digest_of(h.encode())) for x, h, _ in rows]
    assert sorted(map(str, ((g["p"], g["r"], g["d"]) for g in got))) == sorted(map(str, want))
    assert all(g["t"] in (None, *(h for _, h, _ in rows)) and (g["t"] is None) == (g["r"] is not None) for g in got)


def test_runs_by_bytes():
    entries = [{"length": n} for n in (5, 5, 5, 30, 1)]
    assert [[e["length"] for e in run] for run in warc.runs_of(entries, 10)] == [[5, 5], [5], [30], [1]]
    assert warc.runs_of([], 10) == []


def article_of(page, field):
    blocks = html_text.blocks_of(page)
    return "\n".join(text for (text, _, _), keep in zip(blocks, field.decode(blocks)) if keep)


def test_extraction(spark, folder):
    pages = table(spark, folder, "pages")
    field = html_text.train(pages)
    page = ('<body><div id="menu"><a href="/">Home</a></div><div class="post-content"><h1>Title &amp; more</h1><p>First  text\nof the article ends here.'
            "<p>Second, longer text of the article stands here as well.</div>" '<div class="comments"><div class="comment"><p>I like this text.</p></div></div><footer>&copy; me</footer>')
    rows = spark.createDataFrame([(1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<<p <b", "x"), (5, "<p>" * 20_000, "x")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows, field).collect()}
    assert got[1] == "Title & more\nFirst text of the article ends here.\nSecond, longer text of the article stands here as well."
    assert got[2] == got[3] == got[5] == "" and len(got) == 5
    assert html_text.extract(rows.limit(0), field).count() == 0
    twice = html_text.extract(rows.withColumn("_html", F.lit(7)).union(rows.withColumn("_html", F.lit(7))), field)
    assert twice.columns == ["page_id", "html", "_html", "text", "n_chars"] and twice.distinct().count() == 5 and twice.count() == 10


def test_extraction_of_whole_pages(spark, folder):
    """The articles of the given pages stand in their article element, where they are known without the model."""
    rows = QUERIES["op4_html"](spark, folder).join(table(spark, folder, "pages").select("page_id", "html"), "page_id").collect()
    tags = re.compile(r"<(script|style)\b.*?</\1>|<!--.*?-->", re.S)
    right = 0
    for r in rows:
        article = re.search(r"<article.*?</article>", tags.sub(" ", r["html"]), re.S)
        want = {b[0] for b in html_text.blocks_of(re.sub(r'<div class="ad">.*?</div>', " ", article[0], flags=re.S))} if article else set()
        right += want == set(r["text"].split("\n")) - {""}
        assert r["n_chars"] == len(r["text"])
    assert right >= 0.98 * len(rows)


def test_extraction_of_pages_without_usual_tags():
    field = html_text.fit(html_text.labelled(html_text.standard_pages()))
    first, second = "The first paragraph stands here and is long enough to be read.", "A second one follows it, and it ends with a full stop as well."
    assert article_of(f"<title>x</title><article><p>{first}<p>{second}</article>", field) == f"{first}\n{second}"
    assert article_of(f"<html><head><meta charset=utf-8><title>x</title><article><p>{first}<p>{second}</article>", field) == f"{first}\n{second}"
    assert article_of(f"<head><style>a</style>{first}", field) in ("", first) and html_text.blocks_of(f"<head>{first}")[0][0] == first
    assert article_of("<article><p>The sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is <button>not</button> odd.</p><button>Share</button></article>", field) == "The sum x+1 is not odd."
    assert article_of(f"<article><p>{first}</article><div class='user-remarks'><p>I like this text.</p></div>", field) == first


def test_deep_pages_take_little():
    import tracemalloc

    field = html_text.fit(html_text.labelled(html_text.standard_pages()))
    for page in ("<div>x" * 50_000, "".join(f"<div class=a{k}>x" for k in range(50_000))):
        tracemalloc.start()
        blocks = html_text.blocks_of(page)
        assert len(field.decode(blocks)) == len(blocks) == 50_000
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_gains_are_sums_of_features():
    pages = html_text.standard_pages(30)
    field = html_text.fit(html_text.labelled(pages))
    for page in [*pages, "<div class='a b'><p>x<b class=ad>y</b><div class=a><nav>z</nav>w</div>v</div>u"]:
        blocks = html_text.blocks_of(page)
        assert list(field.gains(blocks)) == [sum(field.weights.get(n, 0.0) for n in names) for names in html_text.features(blocks)]


def test_chat(spark, folder):
    conversations = table(spark, folder, "conversations")
    want = [(r["conv_id"], r["role"], f"<|{r['role']}|>\n{r['text']}\n<|end|>\n") for r in conversations.orderBy("conv_id", "turn").collect()]
    got = QUERIES["op9_chat"](spark, folder).orderBy("conv_id", "segment", "line").collect()
    right = sum(w == (g["conv_id"], g["role"], g["rendered"]) for w, g in zip(want, got))
    assert len(got) == len(want) and right >= 0.98 * len(want)
    model = chat.train(conversations)
    rows = [(1, s, "\n".join(f"User: q{s} {k}?\nAssistant: a{k}" for k in range(30))) for s in range(4)] + [(None, 0, "User: hi"), (2, 0, None), (3, 0, "")]
    turns = chat.parse(spark.createDataFrame(rows, "conv_id long, segment long, transcript string"), model)
    assert [r["role"] for r in turns.where("conv_id = 1").orderBy("segment", "line").collect()] == ["user", "assistant"] * 120
    assert turns.where("conv_id is null").count() == 1 and turns.where("conv_id = 2").count() == 0


def _turns(model, transcript):
    return [chat.STATES[k] for k in model.decode(transcript.split("\n"), None, None)]


def test_chat_markers_outweigh_order(spark, folder):
    """Learns from one half of the conversations; the other half is given random roles and styles."""
    found = {}
    for r in table(spark, folder, "conversations").orderBy("conv_id", "turn").collect():
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = [turns for _, turns in sorted(found.items())]
    marked = lambda turns, style: [(role, (chat.STYLES[style][chat.ROLES.index(role)] + text).split("\n")) for role, text in turns]
    model = chat.fit([marked(turns, k % len(chat.STYLES)) for k, turns in enumerate(said[::2])])
    rng = np.random.default_rng(3)
    for turns in said[1::2]:
        turns = marked([(chat.ROLES[rng.integers(3)], text) for _, text in turns], int(rng.integers(len(chat.STYLES))))
        assert _turns(model, "\n".join(x for _, lines in turns for x in lines)) == [(role, k == 0) for role, lines in turns for k in range(len(lines))]
    for own in (model, chat.fit([])):
        assert _turns(own, "Assistant: Hello\nUser: hi") == [("assistant", True), ("user", True)]
        assert _turns(own, "[A] x\n[Q] y") == [("assistant", True), ("user", True)]
        assert _turns(own, "User: hi\nSystem: be brief") == [("user", True), ("system", True)]
        assert _turns(own, "User: a\nUser: b") == [("user", True), ("user", True)]
        assert _turns(own, "User: a\nNote: b\nAI: c") == [("user", True), ("user", False), ("assistant", True)]
    odd = spark.createDataFrame([(1, 0, "Remember: this stays\nUser: hi")] * 2, "conv_id long, segment long, transcript string")
    texts = [r["text"] for r in chat.parse(odd.limit(1), model).orderBy("line").collect()]
    assert texts == ["Remember: this stays", "hi"] and chat.parse(odd, model).count() == 4 and chat.parse(odd.limit(0), model).count() == 0


def test_chained_segments_give_one_pass(spark, folder):
    model = chat.train(table(spark, folder, "conversations"))
    rng = np.random.default_rng(4)
    words = ["User: a?", "AI: b", "plain text", "- item", "", "System: c", "Note: d", "x" * 70]
    lines = [words[k] for k in rng.integers(0, len(words), 400)]
    cuts = [0, *sorted(set(rng.integers(1, 400, 12).tolist())), 400]
    rows = [(1, k, "\n".join(lines[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, segment long, transcript string"), model).orderBy("segment", "line").collect()
    opened = [(cuts[r["segment"]] + r["line"], r["role"]) for r in got if r["opens"]]
    assert opened == [(k, role) for k, (role, opens) in enumerate(_turns(model, "\n".join(lines))) if opens]


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        assert after.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = spark.createDataFrame(after.collect(), docs.schema)
    assert 0 < docs.count() < table(spark, folder, "documents").count()
    done = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, docs, folder), folder)
    assert done.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and done.count() > 0
