"""Mixing by iterative proportional fitting, in DataFrame operations only.

Token weights of the cells source x language x topic are raked in turn to each of the three marginals; a document is
then kept with the probability that brings its cell to its fitted share. Probabilities are scaled so that the largest is 1:
the expected mix is the fitted one, and no document is repeated.

Tokens are a column of the caller's (counts of a tokenizer, say), else words. Targets are given as {dimension: {value: share}}: values that aren't named keep their observed
share, and the named ones divide what is left in the proportions given. A dimension without targets gets its observed shares to the power ``temper``, normalised. The draw is a hash of the
id, so a rerun keeps the same documents. The largest distance of a marginal from its target after the last step is told with each row.

Defined cases: a null source, language or topic is the value ''; texts without tokens (null, empty, blank) have weight 0 and probability 1 (they
don't move the mix); targets of values without any document are ignored; a target of 0 drops its documents; very long texts are counted whole; repeated ids are drawn alike, and rows equal in everything are
kept or not together; there are no ties to break; an empty table gives an empty result. Columns of the input are returned as they are, whatever their names; names that start with two underscores are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DIMENSIONS = ("source", "language", "topic")


def tokens_of(text: Column) -> Column:
    """Words by the blanks and line ends between them; 0 for null, empty and blank texts. Both are told by lengths, which costs far less than a pattern."""
    without = lambda c: F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    n = 2 * F.octet_length(text) - without(" ") - without("\n") + 1
    return F.when(F.trim(text) != "", n).otherwise(0).cast("long")


def topic_of(text: Column) -> Column:
    """What kind of text it is, by its wording and its make over the whole text: licence and copyright lines, addresses, capitals throughout, else short or long prose."""
    legal = text.contains("icensed under") | text.contains("ights reserved") | text.contains("opyright")
    return F.when(legal, "legal").when(text.contains("@"), "contact").when(~text.rlike("[a-z]") & text.rlike("[A-Z]"), "capitals").when(tokens_of(text) < 200, "short").otherwise("long")


def _goals(cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float) -> dict[str, DataFrame]:
    """For each dimension its values with their ``goal``: a share of all tokens."""
    out = {}
    for name in DIMENSIONS:
        column = f"__{name}"
        seen = stored(cells.groupBy(column).agg(F.sum("tokens").cast("double").alias("seen")), "seen")
        if targets and name in targets:
            share = F.lit(None).cast("double")
            for value, x in targets[name].items():
                share = F.when(F.col(column) == value, F.lit(float(x))).otherwise(share)
            seen = seen.withColumn("share", share)
            total, named, rest = seen.agg(F.sum("seen"), F.sum("share"), F.sum(F.when(F.col("share").isNull(), F.col("seen")))).first()
            free = 1.0 - (rest or 0.0) / (total or 1.0)
            goal = F.coalesce(F.col("share") / F.lit(named or 1.0) * F.lit(free), F.col("seen") / F.lit(total or 1.0))
        else:
            total = seen.agg(F.sum(F.pow("seen", F.lit(temper)))).first()[0]
            goal = F.pow("seen", F.lit(temper)) / F.lit(total or 1.0)
        out[name] = stored(seen.select(column, goal.alias("goal")), "goals")
    return out


def _margin(cells: DataFrame, name: str, goals: dict[str, DataFrame]) -> DataFrame:
    return cells.groupBy(f"__{name}").agg(F.sum("weight").alias("now")).join(goals[name], f"__{name}")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.9, iterations: int = 6) -> DataFrame:
    """``cells`` (__source, __language, __topic, tokens) with ``weight``, the fitted share of all tokens, and ``error``, the largest distance of a marginal from its target (one number). Each
    step is a grouped sum and a join."""
    goals = _goals(cells, targets, temper)
    kept = cells.columns
    cells = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for _ in range(iterations):
        for name in DIMENSIONS:
            factor = _margin(cells, name, goals).select(f"__{name}", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            cells = stored(cells.join(factor, f"__{name}").select(*kept, (F.col("weight") * F.col("factor")).alias("weight")), "cells")
    errors = [_margin(cells, name, goals).agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0 for name in DIMENSIONS]
    return cells.withColumn("error", F.lit(max(errors)))


def mixed(docs: DataFrame, source: Column, language: Column, topic: Column, text: Column, doc_id: Column, targets: dict[str, dict[str, float]] | None = None, temper: float = 0.9, iterations: int = 6, seed: str = "mix", tokens: Column | None = None) -> DataFrame:
    """``docs`` with __topic, __tokens, __probability, __kept and __error."""
    named = [F.coalesce(c, F.lit("")).alias(f"__{d}") for d, c in zip(DIMENSIONS, (source, language, topic))]
    marked = docs.select("*", *named, F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("__tokens") if tokens is not None else tokens_of(text).alias("__tokens"))
    keys = [f"__{d}" for d in DIMENSIONS]
    cells = stored(marked.where("__tokens > 0").groupBy(*keys).agg(F.sum("__tokens").alias("tokens")), "cells")
    fitted = rake(cells, targets, temper, iterations).withColumn("ratio", F.col("weight") / F.col("tokens"))
    most, error = fitted.agg(F.max("ratio"), F.max("error")).first()
    rates = fitted.select(*keys, (F.col("ratio") / F.lit(most or 1.0)).alias("__probability"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    out = marked.join(rates, keys, "left").withColumn("__probability", F.when(F.col("__tokens") == 0, 1.0).otherwise(F.coalesce("__probability", F.lit(0.0))))
    return out.withColumns({"__kept": draw < F.col("__probability"), "__error": F.lit(error or 0.0)})
