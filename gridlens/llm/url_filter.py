"""URL filter: rules by host and path, then a weighted vocabulary found by Aho-Corasick.

A rule decides where one fits.  Else the automaton finds all terms of the
vocabulary in the url in one pass; a term counts where it stands between
boundaries.  The weights of the distinct terms found are added: one strict term
reaches REJECT_AT, of the soft ones it takes several different ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.llm.shared import table

STRICT, SOFT = 2, 1
REJECT_AT = 2
# fixed values: the default vocabulary, lower-case ASCII letters, digits and hyphens
STRICT_TERMS = ("bestiality", "camgirls", "hentai", "milf", "porn", "porno", "pornography", "rape", "xvideos", "xxx")
SOFT_TERMS = (
    "adult", "betting", "bitcoin-doubler", "cams", "casino", "cialis", "dating", "escort", "escorts", "gambling", "hookup", "jackpot",
    "nude", "payday", "poker", "sex", "sexy", "slots", "torrent", "viagra", "warez", "webcam",
)
VOCABULARY = {**{t: STRICT for t in STRICT_TERMS}, **{t: SOFT for t in SOFT_TERMS}}
# fixed values: the rules of the query
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
_WORD = frozenset(LOWER + "0123456789")
_HEX = frozenset("0123456789abcdef")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) after the first ``://``, and path; both empty without it."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    stop = min((k for k in (rest.find("?", end), rest.find("#", end)) if k >= 0), default=len(rest))
    return rest[:end].translate(_LOWERED), rest[end:stop]


class RuleBook:
    """Rules ``host/path`` by host; a rule fits its host and all subdomains where the path starts with its own."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, dict[str, str]] = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_LOWERED), {})[slash + path] = verdict
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.by_host.items()}

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest rule that fits; of equally long ones that with the longer host."""
        best, at = None, 0
        while True:
            own = host[at:]
            for n in self.lengths.get(own, ()):
                if n <= len(path) and path[:n] in self.by_host[own]:
                    if best is None or len(own) + n > len(best[0]):
                        best = (own + path[:n], self.by_host[own][path[:n]])
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


class TermCounter:
    """Aho-Corasick automaton of a vocabulary."""

    def __init__(self, vocabulary: Mapping[str, int]):
        import ahocorasick

        self.weights = dict(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for term in self.weights:
            self.automaton.add_word(term, term)
        if self.weights:
            self.automaton.make_automaton()

    def found(self, url: str) -> dict[str, int]:
        """Occurrences of each term between boundaries: the ends of the url, other characters than a-z, A-Z and 0-9,
        or an escape like %20 before it."""
        text, out = url.translate(_LOWERED), {}
        if not self.weights:
            return out
        for last, term in self.automaton.iter(text):
            first = last + 1 - len(term)
            free = first == 0 or text[first - 1] not in _WORD
            free = free or (first >= 3 and text[first - 3] == "%" and text[first - 2] in _HEX and text[first - 1] in _HEX)
            if free and (last + 1 == len(text) or text[last + 1] not in _WORD):
                out[term] = out.get(term, 0) + 1
        return out


def judgement(
    url: Column, rules: Sequence[tuple[str, str]] = RULES, vocabulary: Mapping[str, int] = VOCABULARY, reject_at: int = REJECT_AT
) -> Column:
    """A struct (host, path, rule, verdict, strict_terms, soft_terms, hits) for a column of urls.

    A null url is empty: no host, path, rule or term, so it is allowed.  Rules and
    vocabulary are lists of the caller and travel with the tasks; rows do not move.
    strict_terms and soft_terms count distinct terms, hits all their occurrences.
    """

    @F.pandas_udf("host string, path string, rule string, verdict string, strict_terms int, soft_terms int, hits int")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        book, counter = RuleBook(rules), TermCounter(vocabulary)
        for urls in batches:
            rows = []
            for one in urls:
                one = one if isinstance(one, str) else ""
                host, path = split_url(one)
                terms = counter.found(one)
                weight = sum(vocabulary[t] for t in terms)
                rule = book.longest(host, path)
                verdict = rule[1] if rule else "block" if weight >= reject_at else "allow"
                strict = sum(vocabulary[t] >= reject_at for t in terms)
                rows.append((host, path, rule[0] if rule else None, verdict, strict, len(terms) - strict, sum(terms.values())))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "strict_terms", "soft_terms", "hits"])

    return judge(url)


def judged(pages: DataFrame, id_column: str = "page_id", url: str = "url", **settings) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms, hits), one row per page.

    Repeated rows each give a row, ids may be null or of any type, an empty table
    gives no rows, other columns are left out.  A url is read whole.
    """
    verdicts = pages.select(F.col(id_column).alias("page_id"), judgement(F.col(url), **settings).alias("v"))
    return verdicts.select("page_id", "v.*")


def without_blocked(pages: DataFrame, url: str = "url", **settings) -> DataFrame:
    """The pages whose url is allowed, with all their columns."""
    fresh = "_v" + "_" * max((len(c) for c in pages.columns), default=0)
    return pages.withColumn(fresh, judgement(F.col(url), **settings)).where(F.col(f"{fresh}.verdict") == "allow").drop(fresh)


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged(table(spark, folder, "pages")).drop("hits")


OP13_SQL = f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    row_number() OVER () AS r
  FROM pages
), rules AS (
  SELECT rule, says, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p
  FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}) AS x(rule, says)
), fits AS (
  SELECT r, arg_max(rule, length(rule) * 1000 + length(h)) AS rule, arg_max(says, length(rule) * 1000 + length(h)) AS says
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), terms AS (
  SELECT * FROM (VALUES {", ".join(f"('{t}', {w})" for t, w in VOCABULARY.items())}) AS x(term, weight)
), found AS (
  SELECT r, count(CASE WHEN weight >= {REJECT_AT} THEN 1 END) AS strict_terms, count(CASE WHEN weight < {REJECT_AT} THEN 1 END) AS soft_terms,
    sum(weight) AS total
  FROM u JOIN terms ON regexp_matches(low, '(^|[^0-9a-z]|%[0-9a-f][0-9a-f])' || term || '($|[^0-9a-z])') GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN total >= {REJECT_AT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(strict_terms, 0) AS INTEGER) AS strict_terms, CAST(coalesce(soft_terms, 0) AS INTEGER) AS soft_terms
FROM u LEFT JOIN fits USING (r) LEFT JOIN found USING (r)
"""
