"""Text, dialog and label queries over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.operators import dialog, labels, sentiment, text
from gridlens.plans.registry import Tables, query

# Candidate labels made of words that occur in the documents; one has only stop words.
TOPICS = ("nicht sich keit", "pour dans elle", "this with that", "orantion thon", "ment")
_TOPIC_WORDS = " UNION ALL ".join(
    f"SELECT {i} AS i, '{t}' AS label, unnest({[w for w in t.split() if w not in text.LABEL_STOP_WORDS]}) AS w"
    for i, t in enumerate(TOPICS)
)
_TOPIC_NAMES = " UNION ALL ".join(f"SELECT {i} AS i, '{t}' AS label" for i, t in enumerate(TOPICS))
_LABEL_STOP = ", ".join(f"'{w}'" for w in text.LABEL_STOP_WORDS)
_SUMMARY_STOP = ", ".join(f"'{w}'" for w in text.SUMMARY_STOP_WORDS)

_ZERO_SHOT = f"""WITH tok AS (SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
    WHERE length(w) > 1 AND w NOT IN ({_LABEL_STOP}) GROUP BY doc_id, w),
  norm AS (SELECT doc_id, sqrt(sum(n * n)) AS tn FROM tok GROUP BY doc_id),
  lw AS (SELECT i, label, w, count(*) AS m FROM ({_TOPIC_WORDS}) GROUP BY i, label, w),
  ln AS (SELECT a.i, a.label, sqrt(sum(m * m)) AS ln FROM ({_TOPIC_NAMES}) a
    LEFT JOIN lw ON lw.i = a.i GROUP BY a.i, a.label),
  dot AS (SELECT doc_id, i, CAST(sum(n * m) AS DOUBLE) AS d FROM tok JOIN lw USING (w) GROUP BY doc_id, i),
  sim AS (SELECT x.doc_id, ln.i, ln.label, coalesce(d / (tn * ln.ln), 0) AS s
    FROM documents x CROSS JOIN ln LEFT JOIN norm ON norm.doc_id = x.doc_id
    LEFT JOIN dot ON dot.doc_id = x.doc_id AND dot.i = ln.i),
  p AS (SELECT doc_id, i, label, exp(8 * s) / sum(exp(8 * s)) OVER (PARTITION BY doc_id) AS p FROM sim)
  SELECT doc_id, label, round(p, 4) AS score, printf('%.1f%%', p * 100) AS confidence,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 4) DESC, i) AS INTEGER) AS rank FROM p"""


@query(_ZERO_SHOT)
def zero_shot(t: Tables) -> DataFrame:
    return text.score_labels(t.texts.select("doc_id", "text"), "text", TOPICS)


@query(f"SELECT doc_id, label, score, confidence FROM ({_ZERO_SHOT}) WHERE rank = 1")
def zero_shot_best(t: Tables) -> DataFrame:
    return text.best_label(t.texts.select("doc_id", "text"), "text", TOPICS)


_SUMMARY = rf"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
  cut AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM d),
  sen AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS pos FROM cut),
  sized AS (SELECT doc_id, pos, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s,
    len(list_filter(string_split_regex(s, '\s+'), lambda x: x <> '')) AS n FROM sen),
  kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i,
    count(*) OVER (PARTITION BY doc_id) AS k FROM sized WHERE n > 4),
  freq AS (SELECT doc_id, w, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM d)
    WHERE length(w) > 2 AND w NOT IN ({_SUMMARY_STOP}) GROUP BY doc_id, w),
  top AS (SELECT doc_id, max(c) AS m FROM freq GROUP BY doc_id),
  occ AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(s), '[a-z]+')) AS w FROM kept),
  sums AS (SELECT occ.doc_id, occ.i, CAST(sum(c) AS DOUBLE) AS total
    FROM occ JOIN freq USING (doc_id, w) GROUP BY occ.doc_id, occ.i),
  scored AS (SELECT kept.doc_id, kept.i, s, k,
    round(coalesce(total, 0) / m / n * CASE WHEN kept.i = 0 THEN 1.3::DOUBLE ELSE 1 END, 9) AS score
    FROM kept LEFT JOIN top ON top.doc_id = kept.doc_id
    LEFT JOIN sums ON sums.doc_id = kept.doc_id AND sums.i = kept.i),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, i) AS r FROM scored),
  joined AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS summary FROM best
    WHERE k > 2 AND r <= greatest(1, least(4, k // 3)) GROUP BY doc_id)
  SELECT d.doc_id, coalesce(joined.summary,
    CASE WHEN length(t) > 400 THEN left(t, 400) || '…' ELSE t END) AS summary
  FROM d LEFT JOIN joined ON joined.doc_id = d.doc_id"""


@query(_SUMMARY)
def summary(t: Tables) -> DataFrame:
    return text.summarise(t.texts.select("doc_id", "text"), "text").select("doc_id", "summary")


_WORDS = r"CAST(len(list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')) AS INTEGER)"


@query(
    f"""SELECT x.doc_id, {_WORDS.format(c='text')} AS original_words,
      {_WORDS.format(c='summary')} AS summary_words, {_WORDS.format(c='text')} >= 30 AS long_enough
    FROM documents x JOIN ({_SUMMARY}) y ON x.doc_id = y.doc_id"""
)
def word_counts(t: Tables) -> DataFrame:
    return text.summary_word_counts(t.texts.select("doc_id", "text"), "text")


@query(
    r"""SELECT doc_id, line FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))),
      '^\s+|\s+$', '', 'g') AS line FROM documents) WHERE line <> ''"""
)
def text_lines(t: Tables) -> DataFrame:
    """Non-blank lines: the records of a batch."""
    return text.text_lines(t.documents.select("doc_id", F.col("text").alias("line")), "line")


@query("SELECT doc_id, n_chars FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def non_blank(t: Tables) -> DataFrame:
    return text.non_blank(t.documents.select("doc_id", "text", "n_chars"), "text").select("doc_id", "n_chars")


@query()
def entities(t: Tables) -> DataFrame:
    """All patterns; one of them looks ahead, which the check engine cannot."""
    return text.extract_entities(t.texts.select("doc_id", "text"), "text")


_ASCII = r"regexp_replace(text, '[^\x00-\x7F]', 'x', 'g')"


def _matches(number: int, kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, {number} AS p, '{kind}' AS type, unnest(hits) AS entity, unnest(range(len(hits))) AS i,
      hits, gaps FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits,
      string_split_regex(t, '{pattern}') AS gaps FROM (SELECT doc_id, {_ASCII} AS t FROM documents))"""


_CHECKABLE = [p for p in enumerate(text.ENTITY_PATTERNS) if p[1][0] != "LOC"]


@query(
    "WITH h AS ("
    + " UNION ALL ".join(_matches(i, kind, p.replace(")?)\\b", ")?)\\b")) for i, (kind, p) in _CHECKABLE)
    + """), s AS (SELECT doc_id, p, type, entity, CAST(
        list_sum(list_transform(gaps[1:i + 1], lambda x: length(x)))
        + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0) AS INTEGER) AS start FROM h),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type, entity ORDER BY p, start) AS r FROM s)
      SELECT doc_id, entity, type, '~' AS score, start, CAST(start + length(entity) AS INTEGER) AS "end"
      FROM f WHERE r = 1 AND length(entity) > 1"""
)
def entities_no_place(t: Tables) -> DataFrame:
    """Without the look-ahead, and with letters outside ASCII mapped to x, as the
    engines differ on word boundaries next to them."""
    plain = t.texts.select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    return text.extract_entities(plain, "text", [p for _, p in _CHECKABLE])


@query()
def entity_type_counts(t: Tables) -> DataFrame:
    found = text.extract_entities(t.texts.select("doc_id", "text"), "text")
    return found.groupBy("type").agg(F.count("*").alias("count"))


def _intent_case(rules, column: str) -> str:
    whens = []
    for name, groups in rules:
        tests = [
            "(" + " OR ".join(f"contains(lower({column}), '{k}')" for k in group) + ")"
            for group in groups
        ]
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{dialog.DEFAULT_INTENT}' END"


def _rule_case(rules) -> str:
    names = "".join(f" WHEN '{name}' THEN {i}" for i, (name, _) in enumerate(rules, start=1))
    return f"CASE intent{names} ELSE {len(rules) + 1} END"


_INTENTS = f"SELECT conv_id, turn, {_intent_case(dialog.INTENT_RULES, 'text')} AS intent FROM conversations"


@query(f"SELECT *, CAST({_rule_case(dialog.INTENT_RULES)} AS INTEGER) AS rule FROM ({_INTENTS})")
def intent(t: Tables) -> DataFrame:
    return dialog.message_intents(t.conversations, "text").select("conv_id", "turn", "intent", "rule")


@query(
    f"""SELECT intent, CAST({_rule_case(dialog.INTENT_RULES)} AS INTEGER) AS rule, count(*) AS messages
    FROM ({_INTENTS}) GROUP BY intent"""
)
def intent_counts(t: Tables) -> DataFrame:
    return dialog.intent_counts(t.conversations, "text")


def _word_case(rules, column: str) -> str:
    whens = []
    for name, groups in rules:
        tests = [
            "(" + " OR ".join(
                f"regexp_matches(lower({column}), '(^|[^a-z0-9]){k.strip()}($|[^a-z0-9])')" for k in group
            ) + ")"
            for group in groups
        ]
        whens.append(f"WHEN {' AND '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE '{dialog.DEFAULT_INTENT}' END"


@query(
    f"""SELECT intent, CAST({_rule_case(dialog.INTENT_RULES)} AS INTEGER) AS rule, count(*) AS messages
    FROM (SELECT {_word_case(dialog.INTENT_RULES, 'text')} AS intent FROM documents) GROUP BY intent"""
)
def intent_counts_whole_words(t: Tables) -> DataFrame:
    """Documents as messages, keywords as whole words."""
    return dialog.intent_counts(t.texts, "text", match="word")


@query(
    f"""SELECT intent, CAST({_rule_case(dialog.SHORT_INTENT_RULES)} AS INTEGER) AS rule, count(*) AS messages
    FROM (SELECT {_intent_case(dialog.SHORT_INTENT_RULES, 'text')} AS intent FROM conversations) GROUP BY intent"""
)
def intent_counts_short(t: Tables) -> DataFrame:
    return dialog.intent_counts(t.conversations, "text", dialog.SHORT_INTENT_RULES)


_HINT = "You are a helpful AI assistant. Be concise."


@query(
    f"""SELECT conv_id, turn, prompt, CAST(len(c) AS INTEGER) AS messages,
      coalesce(array_to_string(c, ' | '), '') AS context FROM (SELECT conv_id, turn, role,
        '{_HINT}' || chr(10) || chr(10) || text AS prompt, coalesce(list(role || ': ' || text) OVER (PARTITION BY conv_id
        ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []) AS c
      FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user'"""
)
def chat_context(t: Tables) -> DataFrame:
    found = dialog.chat_context(t.conversations, "conv_id", "turn", "role", "text", hint=_HINT)
    said = F.transform("context", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return found.select(
        "conv_id", "turn", "prompt", F.size("context").alias("messages"),
        F.array_join(said, " | ").alias("context"),
    )


@query(
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d
      FROM embeddings),
    c AS (SELECT label, d, avg(v) AS m FROM x GROUP BY label, d),
    s AS (SELECT x.vec_id, c.label, sum(x.v * c.m) AS s FROM x JOIN c ON x.d = c.d GROUP BY x.vec_id, c.label),
    p AS (SELECT vec_id, label, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS rank FROM p)
    SELECT vec_id, CAST(rank AS INTEGER) AS rank, 'Class ' || label AS label,
      printf('%.2f%%', p * 100) AS confidence, round(p, 4) AS score FROM r WHERE rank <= 5"""
)
def nearest_class_top5(t: Tables) -> DataFrame:
    e = t.embeddings
    centroids = labels.class_centroids(e, "embedding", "label").withColumn("label", F.concat(F.lit("class_"), "label"))
    return labels.nearest_labels(e.select("vec_id", "embedding"), "embedding", centroids)


def _sentiment(t: Tables) -> DataFrame:
    rated = t.texts.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id")
    model = sentiment.train_sentiment(rated, "text", "quality")
    return sentiment.score_sentiment(model, t.texts.select("doc_id", "text"), "text")


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SENTIMENT_SQL = rf"""WITH rated AS (SELECT quality AS y, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND text IS NOT NULL),
    c AS (SELECT word, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y <> 1) AS c0
      FROM (SELECT y, unnest(ws) AS word FROM rated) GROUP BY word),
    n AS (SELECT sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM c),
    m AS (SELECT word, ln((c1 + 1)::DOUBLE / (n1 + v)::DOUBLE) - ln((c0 + 1)::DOUBLE / (n0 + v)::DOUBLE) AS odds FROM c, n),
    p AS (SELECT ln((count(*) FILTER (WHERE y = 1) + 1)::DOUBLE / (count(*) FILTER (WHERE y <> 1) + 1)::DOUBLE) AS prior FROM rated),
    d AS (SELECT row_number() OVER () AS r, doc_id, text,
      regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
      WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
    o AS (SELECT r, sum(odds) AS odds FROM (SELECT r, unnest(ws) AS word FROM d) JOIN m USING (word) GROUP BY r),
    s AS (SELECT doc_id, text, 1 / (1 + exp(-greatest(-30.0::DOUBLE, least(30.0::DOUBLE, prior + coalesce(odds, 0))))) AS q
      FROM d LEFT JOIN o USING (r), p)"""


@query(
    f"""{_SENTIMENT_SQL} SELECT doc_id, left(text, 80) AS text, CASE WHEN q >= 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
      printf('%.1f%%', greatest(q, 1 - q) * 100) AS confidence, round(greatest(q, 1 - q), 4) AS score FROM s"""
)
def sentiment_scores(t: Tables) -> DataFrame:
    """A scorer trained on the labelled documents, applied to all of them."""
    return _sentiment(t)


@query(
    f"""{_SENTIMENT_SQL} SELECT CASE WHEN q >= 0.5 THEN 'Positive' ELSE 'Negative' END AS sentiment, count(*) AS texts
      FROM s GROUP BY 1"""
)
def sentiment_counts(t: Tables) -> DataFrame:
    return sentiment.sentiment_counts(_sentiment(t))


@query(
    r"""SELECT doc_id, left(text, 80) AS text, CASE WHEN m >= 2 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment,
      printf('%.1f%%', CASE WHEN m >= 2 THEN 75.0 ELSE 62.5 END) AS confidence,
      CASE WHEN m >= 2 THEN 0.75 ELSE 0.625 END::DOUBLE AS score
    FROM (SELECT *, len(regexp_extract_all(text, '[.!?]')) AS m FROM documents
      WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""
)
def sentiment_custom_scorer(t: Tables) -> DataFrame:
    """A scorer brought by the caller: two sentence ends make a text positive."""

    def load():
        import pandas as pd

        def score(texts: pd.Series) -> pd.DataFrame:
            good = texts.str.count("[.!?]") >= 2
            return pd.DataFrame(
                {"label": good.map({True: "POSITIVE", False: "NEGATIVE"}),
                 "score": good.map({True: 0.75, False: 0.625})}
            )

        return score

    return sentiment.score_text(t.texts.select("doc_id", "text"), "text", load)
