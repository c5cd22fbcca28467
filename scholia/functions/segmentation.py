"""Words of CJK text by a dictionary: the path of the greatest weight over a trie's matches; what no word covers is taken by characters and pairs."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import STOP_WORDS

RUN = re.compile("[A-Za-z0-9]+|[一-鿿]+")
#: What a character that no word covers weighs, as a share of the least word.
UNKNOWN = 0.1


class Dictionary:
    """A trie of words with weights."""

    def __init__(self, words: Iterable[tuple[str, float | None]]):
        """Words without a weight, or with one that isn't positive, weigh 1; of a word that stands twice the larger weight counts."""
        weights: dict[str, float] = {}
        for w, weight in words:
            w = (w or "").strip()
            if w:
                weights[w] = max(weights.get(w, 0.0), weight if weight and weight > 0 else 1.0)
        total = math.log(sum(weights.values()) or 1.0)
        self.unknown = math.log(UNKNOWN * min(weights.values(), default=1.0)) - total
        self.root: dict = {}
        for w, weight in weights.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = math.log(weight) - total

    def matches(self, run: str, at: int) -> Iterable[tuple[int, float]]:
        """The ends of the words that begin at a place, with their logarithmic shares."""
        node = self.root
        for i in range(at, len(run)):
            node = node.get(run[i])
            if node is None:
                return
            if "" in node:
                yield i + 1, node[""]

    def path(self, run: str) -> list[tuple[str, bool]]:
        """The words of the best path, and whether the dictionary has them. Of paths as good, the one whose first word is longest, and so on."""
        best, step = [0.0] * (len(run) + 1), [(0, False)] * (len(run) + 1)
        for i in range(len(run) - 1, -1, -1):
            best[i], step[i] = self.unknown + best[i + 1], (i + 1, False)
            for end, share in self.matches(run, i):
                if share + best[end] >= best[i] - 1e-12:
                    best[i], step[i] = share + best[end], (end, True)
        out, at = [], 0
        while at < len(run):
            end, known = step[at]
            out.append((run[at:end], known))
            at = end
        return out

    def tokens(self, text: str | None, stop: frozenset[str] = frozenset(STOP_WORDS)) -> list[str]:
        """Distinct search tokens: ASCII words in lower case; of CJK runs the dictionary's words whole, and of what lies between them characters and pairs; but no stop words."""
        out: dict[str, None] = {}
        for run in RUN.findall(text or ""):
            if run[0].isascii():
                out[run.lower()] = None
                continue
            rest = ""
            for word, known in [*self.path(run), ("", True)]:
                if not known:
                    rest += word
                    continue
                for n in (1, 2):
                    out.update((rest[i : i + n], None) for i in range(len(rest) - n + 1) if rest[i : i + n] not in stop)
                rest = ""
                if word and word not in stop:
                    out[word] = None
        return list(out)


def dictionary(words: DataFrame, most_words: int = 500_000) -> Dictionary:
    """The dictionary of a table (word, weight). It goes to every task, so more than ``most_words`` words are refused."""
    rows = words.select("word", F.col("weight").cast("double").alias("weight")).limit(most_words + 1).collect()
    if len(rows) > most_words:
        raise ValueError(f"a dictionary of more than {most_words} words isn't sent to tasks")
    return Dictionary((r.word, r.weight) for r in rows)


def tokens(c: Column | str, words: Dictionary) -> Column:
    """``Dictionary.tokens`` of a text column."""

    @F.arrow_udf("array<string>")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([words.tokens(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return udf(c)
