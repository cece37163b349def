"""Cases in which an operator once did less than the whole job, against plain Python."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridlens.llm import decontaminate, html_text, jaccard, tokens, toxicity


def _best_windows(docs, items, percent=75):
    """(doc, item) -> (similarity, start) of the best window, by trying all of them."""
    found = {}
    for i, text in docs:
        words = (text or "").lower().split()
        for j, item in items:
            own = (item or "").lower().split()
            k = min(5, len(own))
            grams = lambda w: Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
            for start in range(max(0, len(words) - len(own)) + 1 if own else 0):
                a, b = grams(words[start : start + len(own)]), grams(own)
                common, total = sum((a & b).values()), sum((a | b).values())
                if common and common * 100 >= total * percent and common / total > found.get((i, j), (0, 0))[0]:
                    found[i, j] = (common / total, start)
    return found


def test_leaks_by_all_windows(spark):
    rng = np.random.default_rng(3)
    items = [(j, " ".join(f"w{j}x{a}" for a in range(n))) for j, n in enumerate((3, 12, 40, 40, 60, 90))]
    items.append((9, "again and again " * 12))
    filler = lambda n: [f"f{x}" for x in rng.integers(0, 50, n)]
    docs = []
    for j, item in items:
        words = item.split()
        half = len(words) // 2
        thirds = [words[: len(words) // 3], words[len(words) // 3 : 2 * len(words) // 3], words[2 * len(words) // 3 :]]
        edited = [*words]
        edited[half] = "other"
        forms = (words, words[half:] + words[:half], sum(thirds[::-1], []), edited, edited[half:] + edited[:half], words[:half] + ["put", "in"] + words[half:], words[2:], words[:half])
        docs += [(100 * j + f, " ".join(filler(int(rng.integers(0, 9))) + form + filler(int(rng.integers(0, 9))))) for f, form in enumerate(forms)]
        docs.append((100 * j + 50, " ".join(words[half:] + words[:half])))
    want = _best_windows(docs, items)
    assert (201, 2) in want and (401, 4) in want  # halves in the other order
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]): (r["similarity"], r["word_start"]) for r in rows} == want and len(rows) == len(want)


def test_leaks_of_items_without_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    bench = spark.createDataFrame([(None, a), (None, b), (None, b), (1, a), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, "x " + b), (3, a + " " + b), (4, "clean words"), (None, b)], "doc_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["word_start"]) for r in rows) == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (2, 0, 1), (3, 0, 0), (3, 0, 20), (3, 1, 0)]
    assert [r["doc_id"] for r in decontaminate.without_leaks(docs, bench).collect()] == [4]


def test_broadcast_counts_array_elements(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_CELLS", 10)
    df = spark.createDataFrame([(1, [1] * 4), (2, [2] * 4)], "item long, hashes array<long>")
    plan = lambda x: x._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(decontaminate.small(df.select("item"))) and "broadcast" in plan(decontaminate.small(df.limit(1)))
    assert "broadcast" not in plan(decontaminate.small(df.union(df)))


def test_toxicity_of_every_place():
    clean = [f"the plain text number {i} says nothing of note about thing{i % 7}" for i in range(200)]
    bad = [f"the plain text number {i} says you {w} about thing{i % 7}" for i, w in enumerate(["grobblex", "grobblen", "grobblet", "grobbled"] * 50)]
    scorer = toxicity.Scorer(toxicity.fit([t for pair in zip(clean, bad) for t in pair], [0, 1] * 200))
    fill = ["plain"]
    scores = scorer.score([" ".join(fill * k + ["you", "grobblex", "grobblen"] + fill * 9) for k in range(4, 9)])
    assert np.ptp(scores) < 1e-9 and scores.min() >= 0.3  # whatever number of words stands before
    start = "the_plain_text_number_says_nothing_of_note_about_the_plain_text_"
    assert len(start) == 64
    for between in ("_", "/", ".", "\u200b"):
        calm, toxic = scorer.score([(start + tail).replace("_", between) for tail in ("says_nothing_of_note", "you_grobblex_grobblen_grobblet")])
        assert calm < 0.3 <= toxic
    pieces = toxicity.words_of("".join(chr(0x4E00 + k) for k in range(1000)))
    grams = {p[k : k + 5] for p in pieces for k in range(len(p) - 4)}
    assert {"".join(chr(0x4E00 + k + j) for j in range(5)) for k in range(996)} <= grams


def test_capitals_before_combining_marks():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.word_bpe_path())
    texts = [f"{a}Plain WORD{a}. {c}{m}{b}" for a in ("", "x. ") for b in ("", "am,", " Next.") for c in "THJWAEtn" for m in ("\u0308", "\u0331", "\u030c", "\u030a", "\u0323\u0308")]
    texts += ["PLAIN Words", "<|x T\u0308"]
    ids, bounds = tokens.PieceEncoder(tokens.word_bpe_path()).batch(pa.array(texts, pa.string()), 1)
    got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [[*whole.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_groups_of_a_class_are_bounded(spark):
    rng = np.random.default_rng(7)
    crowded = rng.integers(0, 1 << 62, (5000, 100)).min(axis=1)
    rows = [(k, 1, int(x)) for k, x in enumerate(crowded)] + [(5000 + k, 2, 17) for k in range(3000)] + [(8000 + k, 8000 + k, 5) for k in range(50)]
    found = jaccard.grouped(spark.createDataFrame(rows, "node long, class long, near long"))
    sizes = found.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes")).collect()
    assert sum(r["n"] for r in sizes) == len(rows) == found.select("node").distinct().count()
    assert max(r["n"] for r in sizes) <= jaccard.GROUP and {r["classes"] for r in sizes} == {1}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) <= 8000 // jaccard.GROUP + 50 + 2 * parts


def test_one_row_of_near_copies_without_ids(spark):
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(None, words, "a"), (None, words, "a"), (None, words + " more", "b"), (None, "lone text", "c"), (None, "lone text", "d")]
    rows += [(None, None, "e"), (None, None, "e"), (7, " ", "f"), (7, " ", "f"), (8, "", "g")]
    kept = [(None, "lone text"), (None, None), (None, None), (7, " "), (7, " "), (8, "")]
    for extra in ([], [(9, "other text", "h"), (9, "other text", "h")]):  # an unrelated row that repeats
        got = [tuple(r) for r in jaccard.without_near_copies(spark.createDataFrame(rows + extra, "doc_id long, text string, source string")).select("doc_id", "text").collect()]
        near = [r for r in got if r[1] and r[1].startswith("word")]
        assert len(near) == 1
        assert sorted(map(repr, set(got) - set(near))) == sorted(map(repr, set(kept + [r[:2] for r in extra])))
        assert len(got) == 1 + len(kept) + len(extra) // 2


def test_pages_without_landmarks(spark):
    first, second = "First text\nof the article ends here, after some more words.", "Second, longer text of the article stands here as well."
    page = (f'<body><div id="menu"><a href="/">Home</a></div><div class="%s"><h1>Title</h1><p>{first}</p><p>{second}</p></div>'
            '<div class="comments"><div class="comment"><p>I like this text.</p></div></div><footer>&copy; me</footer></body>')
    long = "<body><article><h1>Title</h1><p>" + first + "</p><!--" + "x" * 50_000 + "--><p>" + second + "</p></article></body>"
    want = "\n".join(["Title", first.replace("\n", " "), second])
    for texts in ([page % "post-content", page % "entry", page % "box"], [long]):
        pages = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
        assert [r["text"] for r in html_text.extract(pages, html_text.train(pages)).collect()] == [want] * len(texts)


def test_all_words_of_class_and_id_are_marks():
    utility = " ".join(f"flex mt-{k} text-sm" for k in range(10))
    marks = html_text._marks(f' class="{utility} sidebar" id="comments"')[0]
    assert {"sidebar", "comments"} <= set(marks)


def test_training_without_a_usable_class(spark):
    """No labels, labels in the held-out fold only, or one class only: nothing is rejected.  Long texts are fitted by a piece."""
    ids = [r["id"] for r in spark.range(4000).where(~toxicity.held_out(F.col("id"))).limit(600).collect()]
    held = [r["id"] for r in spark.range(400).where(toxicity.held_out(F.col("id"))).limit(40).collect()]
    docs = spark.createDataFrame([(i, f"a fine day number {i}") for i in ids + held], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for rows in ([], [(i, k % 2) for k, i in enumerate(held)], [(i, 1) for i in ids[:50]], [(i, 0) for i in ids[:50]]):
        model = toxicity.train(docs, label(rows))
        assert toxicity.score(docs, model).where("score >= 0.3").count() == 0
    filler = "calm words of the day go on and on " * 200
    texts = [(i, ("you grobblez and grobblex here " if k % 2 else "we met a friend and talked ") + filler) for k, i in enumerate(ids)]
    long_docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(long_docs, label([(i, k % 2) for k, i in enumerate(ids)] * 2 + [(ids[0], 1)]))
    clean, bad = toxicity.Scorer(model).score(["we met a friend", "you grobblez and grobblex"])
    assert clean < bad


def test_random_texts_encode_like_the_tokenizer():
    """Letters whose small or composed form holds a mark, combining marks, all ASCII marks."""
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(tokens.word_bpe_path()), tokens.PieceEncoder(tokens.word_bpe_path())
    rng = np.random.default_rng(11)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    letters = list("aAbİıIéÉßŉﬁΣσςǰẖÅКйЙक़ग़שּׁ각ﬀ中") + ["e\u0301", "i\u0307", "I\u0307", "T\u0308", "\u0301", "\u0958", "\ufb2a", "x\u0323"]
    others = [" ", " ", "\n", "\t", "\u00a0", "5", "٣", "…", "<|"]
    alphabet = np.array(letters * 2 + marks + others * 2, dtype=object)
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(30_000)] + ["Sn. İ. Yılmaz", "İ,", "(İ)", "Ali İ.", "\u0958. \u0958,"]
    for at in range(0, len(texts), 1000):
        part = texts[at : at + 1000]
        ids, bounds = encoder.batch(pa.array(part, pa.string()), 1)
        for k, text in enumerate(part):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], repr(text)
