"""Text operators whose work stays inside the row: no key, no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.arrays import let, preceding_sums, runs, softmax, total
from gridlens.functions.columns import quoted

# Words that carry no topic when texts are matched to labels.
LABEL_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should "
    "may might can to of in for on with at by from as and but or not it its this that i we you "
    "he she they all any more so very also just about"
).split()

# Words that do not count towards the weight of a sentence.
SUMMARY_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should "
    "may might can to of in for on with at by from as into and but or not it its this that i "
    "we you he she they all any each more most so very also just about than other such when which"
).split()

# The blanks of Unicode.
BLANKS = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
BLANK = f"[{BLANKS}]"
MAX_SUMMARY_SENTENCES = 4
SHORT_TEXT_CHARS = 400
FIRST_SENTENCE_FACTOR = 1.3
LABEL_SHARPNESS = 8.0


def stripped(text: Column) -> Column:
    """Text without blanks at either end."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Runs of a-z in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of blank-separated words."""
    return F.size(F.filter(F.split(text, f"{BLANK}+"), lambda w: w != ""))


def non_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(stripped(quoted(text))) > 0)


def text_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per non-blank line, stripped; other columns repeat."""
    line = F.explode(F.split(quoted(text), "\n"))
    rest = [quoted(c) for c in df.columns if c != text]
    return non_blank(
        df.select(*rest, line.alias("_line")).select(
            *[c for c in df.columns if c != text], stripped(F.col("_line")).alias(text)
        ),
        text,
    )


def score_labels(df: DataFrame, text: str, labels: Sequence[str]) -> DataFrame:
    """Candidate labels of each text by word overlap: (other columns, label,
    score, confidence, rank).

    Cosine of word counts without stop words, softmax at sharpness 8 over the
    labels, score to 4 digits; equal scores keep the order of the labels.
    """
    kept = [c for c in df.columns if c != text]
    labels = list(labels)
    if not labels:
        return df.select(*kept).limit(0).select(
            *kept, F.lit("").alias("label"), F.lit(0.0).alias("score"),
            F.lit("").alias("confidence"), F.lit(0).alias("rank"),
        )
    vocabulary = sorted({w for label in labels for w in _label_words(label)})
    tokens = F.filter(
        words(quoted(text)), lambda w: (F.length(w) > 1) & ~w.isin(LABEL_STOP_WORDS)
    )

    def counted(ordered: Column) -> Column:
        """Squared norm of the text, and its counts of words that labels use."""

        def measure(spans: Column) -> Column:
            norm = F.sqrt(total(F.transform(spans, lambda r: (r["len"] * r["len"]).cast("double"))))
            pairs = F.transform(
                spans, lambda r: F.struct(F.get(ordered, r["start"]).alias("w"), r["len"].alias("n"))
            )
            hits = F.filter(pairs, lambda p: p["w"].isin(vocabulary) if vocabulary else F.lit(False))
            return F.struct(norm.alias("norm"), hits.alias("hits"))

        return let(runs(ordered, lambda w: w), measure)

    def occurrences(word: str) -> Column:
        hit = F.get(F.filter("_m.hits", lambda p: p["w"] == word), F.lit(0))
        return F.coalesce(hit["n"], F.lit(0))

    def similarity(label: str) -> Column:
        own = _label_words(label)
        if not own:
            return F.lit(0.0)
        size = sum(own.count(w) ** 2 for w in set(own)) ** 0.5
        dot = F.lit(0.0)
        for w in sorted(set(own)):
            dot = dot + occurrences(w) * F.lit(float(own.count(w)))
        return F.coalesce(F.try_divide(dot, F.col("_m.norm") * F.lit(size)), F.lit(0.0))

    measured = df.select(*[quoted(c) for c in kept], let(F.sort_array(tokens), counted).alias("_m"))
    shares = measured.select(
        *[quoted(c) for c in kept],
        softmax(F.array(*[similarity(v) * LABEL_SHARPNESS for v in labels])).alias("_p"),
    )
    names = F.array(*[F.lit(v) for v in labels])
    ranked = F.sort_array(
        F.transform(
            F.col("_p"),
            lambda p, i: F.struct(
                (-F.round(p, 4)).alias("neg"), i.alias("i"), F.get(names, i).alias("label"), p.alias("p")
            ),
        )
    )
    return shares.select(*[quoted(c) for c in kept], F.posexplode(ranked).alias("_i", "_r")).select(
        *[quoted(c) for c in kept],
        F.col("_r.label").alias("label"),
        (-F.col("_r.neg")).alias("score"),
        F.format_string("%.1f%%", F.col("_r.p") * 100).alias("confidence"),
        (F.col("_i") + 1).alias("rank"),
    )


def _label_words(label: str) -> list[str]:
    import re

    return [
        w for w in re.findall("[a-z]+", label.lower()) if len(w) > 1 and w not in LABEL_STOP_WORDS
    ]


def best_label(df: DataFrame, text: str, labels: Sequence[str]) -> DataFrame:
    return score_labels(df, text, labels).where("rank = 1").drop("rank")


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by blanks."""
    return F.split(stripped(text), f"(?<=[.!?]){BLANK}+")


def summarise(df: DataFrame, text: str, name: str = "summary") -> DataFrame:
    """Append an extractive summary built from the heaviest sentences.

    Sentences of over four words count.  With two of them or fewer the summary
    is the start of the text.  Otherwise a word weighs its count over the count
    of the most frequent one, a sentence the sum of its words over their
    number, the first sentence 1.3 times that; the best third, one to four, is
    kept in text order.
    """
    kept = let(
        sentences(quoted(text)),
        lambda all_: let(
            F.transform(all_, lambda s: F.struct(stripped(s).alias("s"), word_count(s).alias("n"))),
            lambda sized: F.struct(
                F.filter(sized, lambda s: s["n"] > 4).alias("good"),
                F.filter(sized, lambda s: s["n"] <= 4).alias("other"),
            ),
        ),
    )
    parts = df.withColumn("_kept", kept)

    def occurrences(group: str, numbered: bool) -> Column:
        return F.flatten(
            F.transform(
                F.col(f"_kept.{group}"),
                lambda s, i: F.transform(
                    F.filter(words(s["s"]), lambda w: (F.length(w) > 2) & ~w.isin(SUMMARY_STOP_WORDS)),
                    lambda w: F.struct(w.alias("w"), (i if numbered else F.lit(-1)).alias("i")),
                ),
            )
        )

    def weigh(ordered: Column) -> Column:
        """(sentence, count of the word in the whole text) per occurrence."""
        return let(
            runs(ordered, lambda x: x["w"]),
            lambda spans: F.struct(
                F.array_max(F.transform(spans, lambda r: r["len"])).alias("top"),
                F.sort_array(
                    F.flatten(
                        F.transform(
                            spans,
                            lambda r: F.transform(
                                F.filter(F.slice(ordered, r["start"] + 1, r["len"]),
                                         lambda x: x["i"] >= 0),
                                lambda x: F.struct(x["i"].alias("i"), r["len"].alias("n")),
                            ),
                        )
                    )
                ).alias("hits"),
            ),
        )

    def sentence_sums(hits: Column) -> Column:
        return let(
            runs(hits, lambda x: x["i"]),
            lambda spans: F.transform(
                spans,
                lambda r: F.struct(
                    F.get(hits, r["start"])["i"].alias("i"),
                    total(
                        F.transform(F.slice(hits, r["start"] + 1, r["len"]),
                                    lambda x: x["n"].cast("double"))
                    ).alias("sum"),
                ),
            ),
        )

    def pick(sums: Column) -> Column:
        scored = F.transform(
            sums,
            lambda t: F.struct(
                (-F.round(
                    t["sum"] / F.col("_w.top") / F.get(F.col("_kept.good"), t["i"])["n"]
                    * F.when(t["i"] == 0, FIRST_SENTENCE_FACTOR).otherwise(1.0), 9,
                )).alias("neg"),
                t["i"].alias("i"),
            ),
        )
        missing = F.array_except(
            F.sequence(F.lit(0), F.size("_kept.good") - 1), F.transform(sums, lambda t: t["i"])
        )
        zero = F.transform(missing, lambda i: F.struct((-F.lit(0.0)).alias("neg"), i.alias("i")))
        n = F.greatest(
            F.lit(1),
            F.least(F.lit(MAX_SUMMARY_SENTENCES), F.floor(F.size("_kept.good") / 3).cast("int")),
        )
        best = F.slice(F.sort_array(F.concat(scored, zero)), F.lit(1), n)
        order = F.sort_array(F.transform(best, lambda x: x["i"]))
        return F.array_join(F.transform(order, lambda i: F.get(F.col("_kept.good"), i)["s"]), " ")

    whole = stripped(quoted(text))
    short = F.when(
        F.length(whole) > SHORT_TEXT_CHARS,
        F.concat(F.substring(whole, 1, SHORT_TEXT_CHARS), F.lit("…")),
    ).otherwise(whole)
    weighed = parts.withColumn(
        "_w",
        let(
            F.sort_array(F.concat(occurrences("good", True), occurrences("other", False))), weigh
        ),
    )
    return weighed.withColumn(
        name,
        F.when(F.size("_kept.good") <= 2, short).otherwise(
            let(let(F.col("_w.hits"), sentence_sums), pick)
        ),
    ).select(*df.columns, name)


def summary_word_counts(df: DataFrame, text: str, min_words: int = 30) -> DataFrame:
    """(other columns, original_words, summary_words, long_enough)."""
    return summarise(df, text, "_summary").select(
        *[quoted(c) for c in df.columns if c != text],
        word_count(quoted(text)).alias("original_words"),
        word_count(F.col("_summary")).alias("summary_words"),
        (word_count(quoted(text)) >= min_words).alias("long_enough"),
    )


# Name patterns, in the order in which they are tried.
ENTITY_PATTERNS = (
    (
        "ORG",
        r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|Ltd|LLC|Co|Group|Foundation|Institute|"
        r"University|College|School|Hospital|Bank|Technologies|Solutions|Systems|Services)\.?)\b",
    ),
    (
        "LOC",
        r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b(?=\s+(?:City|State|Country|Street|Avenue|"
        r"Road|Park|Lake|River|Mountain|Valley|Island|Bay|County|District|Province|Region))",
    ),
    ("PER", r"\b([A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})?)\b"),
    ("ORG", r"\b([A-Z]{2,6})\b"),
)


_SUFFIX = ENTITY_PATTERNS[0][1].partition(r"\s+(?:Inc|")[2].partition(r")\.?")[0]
_SUFFIX = "Inc|" + _SUFFIX
_PLACE = ENTITY_PATTERNS[1][1].partition(r"(?=\s+(?:")[2].removesuffix("))")


def _linear_forms() -> dict[str, str]:
    """The patterns with unbounded runs of words, in a form that reads a run once.

    A run is taken word by word without stepping back, from one suffix or place
    word to the next; a run that has none is passed over as a whole, without group 1.
    """
    word, name = r"[A-Z][a-z]+", r"[A-Z][a-zA-Z]+"
    plain = "|".join(w for w in _SUFFIX.split("|") if not w.isupper())
    capital = "|".join(w for w in _SUFFIX.split("|") if w.isupper())
    between = rf"(?:\s+(?!(?:{_SUFFIX})\b){word})*+"
    to_plain, to_capital = rf"{between}\s+(?:{plain})\b", rf"{between}\s+(?:{capital})\b"
    org = rf"\b(?:({word}(?:(?:{to_plain})++(?:{to_capital})?+|{to_capital})\.?)\b|{word}(?:\s+{word})*+)"
    to_place = rf"(?:\s+(?!{_PLACE}){name}\b)*+(?=\s+(?:{_PLACE}))"
    to_place = to_place.replace(f"(?!{_PLACE})", f"(?!(?:{_PLACE}))")
    loc = rf"\b(?:({name}\b{to_place}(?:\s+(?=(?:{_PLACE})){name}\b{to_place})*+)|{name}(?:\s+{name})*+)"
    return {ENTITY_PATTERNS[0][1]: org, ENTITY_PATTERNS[1][1]: loc}


LINEAR_FORMS = _linear_forms()


def extract_entities(
    df: DataFrame, text: str, patterns: Sequence[tuple[str, str]] = ENTITY_PATTERNS
) -> DataFrame:
    """(other columns, entity, type, score, start, end), the first of each entity
    and type per text; offsets count characters from 0.  An entity is group 1 of a
    pattern.  One pass over each text in Arrow batches; only the entities come back.
    """
    kept = [c for c in df.columns if c != text]
    forms = [(label, LINEAR_FORMS.get(pattern, pattern)) for label, pattern in patterns]

    @F.pandas_udf("array<struct<entity:string,type:string,start:int,end:int>>")
    def entities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(label, re.compile(form)) for label, form in forms]
        for part in parts:
            out = []
            for value in part:
                seen: dict[tuple[str, str], tuple] = {}
                for label, form in compiled if isinstance(value, str) else ():
                    for m in form.finditer(value):
                        if m[1] is not None and len(m[1]) > 1:
                            seen.setdefault((m[1], label), (m[1], label, m.start(1), m.end(1)))
                out.append([dict(zip(("entity", "type", "start", "end"), x)) for x in seen.values()])
            yield pd.Series(out)

    rows = df.select(*[quoted(c) for c in kept], F.explode(entities(quoted(text))).alias("e"))
    return rows.select(
        *[quoted(c) for c in kept],
        F.col("e.entity").alias("entity"),
        F.col("e.type").alias("type"),
        F.lit("~").alias("score"),
        F.col("e.start").alias("start"),
        F.col("e.end").alias("end"),
    )
