"""Query op8: every document with its fitted probability and whether it is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .mixing import mixed, topic_of

ITERATIONS, TEMPER = 8, 0.9
#: Shares of words that the mix shall have; sources get their observed shares to the power TEMPER, other topics keep theirs.
TARGETS = {"language": {"en": 0.5, "de": 0.2, "es": 0.15, "fr": 0.15}, "topic": {"long": 0.7, "short": 0.1}}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixed(docs, F.col("source"), F.col("lang"), topic_of(F.col("text")), F.col("text"), F.col("doc_id"), TARGETS, TEMPER, ITERATIONS)
    return out.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__probability", 6).alias("probability"), F.col("__kept").alias("kept"), F.round("__error", 6).alias("marginal_error"))


def _goal(d: str, name: str) -> str:
    if name not in TARGETS:
        return f"goal_{d} AS (SELECT {d}, power(sum(n), {TEMPER}) / sum(power(sum(n), {TEMPER})) OVER () AS g FROM cells GROUP BY {d})"
    values = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in TARGETS[name].items())
    return f"""given_{d} AS (SELECT * FROM (VALUES {values}) AS x({d}, share)),
seen_{d} AS (SELECT {d}, CAST(sum(n) AS DOUBLE) AS seen FROM cells GROUP BY {d}),
goal_{d} AS (SELECT {d}, coalesce(share / sum(share) OVER () * (1.0 - coalesce(sum(CASE WHEN share IS NULL THEN seen END) OVER (), 0) / sum(seen) OVER ()), seen / sum(seen) OVER ()) AS g FROM seen_{d} LEFT JOIN given_{d} USING ({d}))"""


def _sql() -> str:
    """The same raking as a chain of windows."""
    steps = [f"""WITH counted AS (
  SELECT *, CASE WHEN trim(text) <> '' THEN 2 * strlen(text) - strlen(replace(text, ' ', '')) - strlen(replace(text, chr(10), '')) + 1 ELSE 0 END AS tokens FROM documents
), marked AS (
  SELECT doc_id, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l,
    CASE WHEN contains(text, 'icensed under') OR contains(text, 'ights reserved') OR contains(text, 'opyright') THEN 'legal' WHEN contains(text, '@') THEN 'contact'
      WHEN NOT regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]') THEN 'capitals' WHEN tokens < 200 THEN 'short' ELSE 'long' END AS t,
    tokens, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 8) AS BIGINT) / 4294967296.0 AS draw FROM counted
), cells AS (SELECT s, l, t, sum(tokens) AS n, CAST(sum(tokens) AS DOUBLE) AS w0 FROM marked WHERE tokens > 0 GROUP BY s, l, t)"""]
    for d, name in zip("slt", ("source", "language", "topic")):
        steps.append(_goal(d, name))
    last = "cells"
    for i in range(3 * ITERATIONS):
        d = "slt"[i % 3]
        steps.append(f"step{i + 1} AS (SELECT x.s, x.l, x.t, x.n, x.w{i} * g / sum(x.w{i}) OVER (PARTITION BY x.{d}) AS w{i + 1} FROM {last} x JOIN goal_{d} USING ({d}))")
        last = f"step{i + 1}"
    w = f"w{3 * ITERATIONS}"
    margins = " UNION ALL ".join(f"SELECT abs(sum({w}) - any_value(g)) AS e FROM {last} JOIN goal_{d} USING ({d}) GROUP BY {d}" for d in "slt")
    steps.append(f"rates AS (SELECT s, l, t, {w} / n / max({w} / n) OVER () AS p FROM {last})")
    steps.append(f"errors AS (SELECT round(max(e), 6) AS marginal_error FROM ({margins}))")
    return ", ".join(steps) + """ SELECT doc_id, source, lang, t AS topic, tokens, round(CASE WHEN tokens = 0 THEN 1.0 ELSE p END, 6) AS probability,
  draw < CASE WHEN tokens = 0 THEN 1.0 ELSE p END AS kept, marginal_error FROM marked LEFT JOIN rates USING (s, l, t) CROSS JOIN errors"""


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {"op8_mixing": _sql()}
