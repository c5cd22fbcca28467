"""Language identification: script ranges, per-word scores, and Viterbi spans.

``train`` learns, from labelled rows, log-probabilities of letter trigrams per language and the scripts each
language is written in. ``identify`` scores each word of a text under every language whose scripts hold the word,
and the best path through the words, where each change of language costs ``switch_penalty``, labels the spans of a
text of mixed languages.

Defined cases: null text, and text without a letter, give ``und`` with score 0.0 and no span; a text whose letters
belong to no learned script gets the most frequent learned language with score 0.0; ties go to the language that is
more frequent in training, then to the smaller name; repeated rows get equal results; very long texts are labelled whole, word by word; an empty table gives an empty result. The script of a
word is that of its first letter. The model is bounded by two parameters: ``docs_per_language`` and ``max_trigrams`` (rarer trigrams say nothing). These are a model and a column function: other
columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First code points of Unicode script ranges, in order, with the script that starts there.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB10, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"),
]
_STARTS, _SCRIPTS = np.array([s for s, _ in SCRIPT_STARTS]), np.array([n for _, n in SCRIPT_STARTS])
WORD = re.compile(r"[^\W\d_]+")
RESULT = "struct<lang_pred:string,score:double,n_spans:int,spans:array<struct<lang:string,start:int,end:int>>>"


def script_of(char: str) -> str:
    return str(_SCRIPTS[np.searchsorted(_STARTS, ord(char), side="right") - 1])


@dataclass
class LanguageModel:
    """Languages by falling frequency, trigram -> row of ``table`` (a log-probability per language), script -> languages."""

    languages: list[str]
    trigrams: dict[str, int]
    table: np.ndarray
    scripts: dict[str, np.ndarray]
    _words: dict[str, int] = field(default_factory=dict, repr=False)
    _rows: np.ndarray | None = field(default=None, repr=False)
    _keys: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_words": {}, "_rows": None, "_keys": None}

    def rows_of(self, words: list[str], keep: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``words`` in the score table, and that table. Scores of the first ``keep`` words are remembered."""
        known = self._words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            scores = self._score(new)
            start = len(known)
            if self._rows is None or start + len(new) > len(self._rows):
                grown = np.zeros((max(start + len(new), 2 * start, 4096), len(self.languages)), np.float32)
                if self._rows is not None:
                    grown[:start] = self._rows[:start]
                self._rows = grown
            self._rows[start : start + len(new)] = scores
            known.update(zip(new, range(start, start + len(new))))
        rows = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > keep:
            for w in new:
                del known[w]
        return rows, self._rows

    def _score(self, words: list[str]) -> np.ndarray:
        """Sums of the trigrams' rows of each word between ^ and $; -inf under languages that don't hold the word's script."""
        if self._keys is None:
            grams = np.array([_gram_keys(np.frombuffer(g.ljust(3, "\0").encode("utf-32-le"), "<u4"))[0] for g in self.trigrams], np.uint64)
            order = np.argsort(grams)
            self._keys = grams[order], np.vstack([self.table[np.array(list(self.trigrams.values()), np.int64)[order]], np.zeros((1, len(self.languages)), np.float32)])
        keys, table = self._keys
        letters = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), "<u4")
        grams = _gram_keys(letters)
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)[:-1]])
        if len(keys):
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            rows = np.where(keys[at] == grams, at, len(keys))
        else:
            rows = np.zeros(len(grams), np.int64)
        inside = np.ones(len(letters), bool)  # a word of n letters has n trigrams; those that reach into the next word don't count
        inside[starts[1:] - 1] = inside[starts[1:] - 2] = False
        rows = np.where(inside[: len(rows)], rows, len(keys))
        sums = np.add.reduceat(table[rows], starts, axis=0)
        scripts = _SCRIPTS[np.searchsorted(_STARTS, letters[starts + 1], side="right") - 1]
        if "Latin" in self.scripts and self.scripts["Latin"].all():
            odd = np.flatnonzero(scripts != "Latin")
        else:
            odd = np.arange(len(words))
        none = np.zeros(len(self.languages), bool)
        for name in set(scripts[odd].tolist()):
            of = odd[scripts[odd] == name]
            sums[of] = np.where(self.scripts.get(name, none), sums[of], -np.inf)
        return sums


def _gram_keys(letters: np.ndarray) -> np.ndarray:
    x = letters.astype(np.uint64)
    return (x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 1500, max_trigrams: int = 100_000) -> LanguageModel:
    """Learn a model from ``labelled``. About ``docs_per_language`` rows of each language are used, chosen by a hash of the id;
    the model holds the ``max_trigrams`` most frequent trigrams. Both bounds are fixed, so the model's size doesn't follow the input's."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), {})
    share = F.coalesce(*[F.when(F.col("l") == k, F.lit(min(1.0, docs_per_language / n))) for k, n in sizes.items()])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.col("t"))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    words = rows.where(draw < share).select("l", F.explode(F.expr(r"regexp_extract_all(lower(t), '\\p{L}+', 0)")).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n"))
    grams = words.select("l", "n", F.explode(F.expr("transform(sequence(1, length(w)), i -> substring(concat('^', w, '$'), i, 3))")).alias("g")).groupBy("g", "l").agg(F.sum("n").alias("n"))
    top = grams.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("by"), F.sum("n").alias("all")).orderBy(F.desc("all"), "g").limit(max_trigrams).collect()
    languages = sorted(sizes, key=lambda k: (-sizes[k], k))
    counts = np.array([[r.by.get(k, 0) for k in languages] for r in top], np.float64).reshape(len(top), len(languages))
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * max(1, len(top))))
    scripts: dict[str, np.ndarray] = {}
    for r, c in zip(top, counts):
        letter = r.g[1] if len(r.g) > 1 else "$"
        if letter not in "^$":
            scripts[s] = scripts.get(s := script_of(letter), np.zeros(len(languages))) + c
    total = np.maximum(1, sum(scripts.values())) if scripts else 1
    return LanguageModel(languages, {r.g: i for i, r in enumerate(top)}, (logs - logs.mean(1, keepdims=True)).astype(np.float32), {k: v / total >= 0.01 for k, v in scripts.items()})


def best_path(scores: np.ndarray, lengths: np.ndarray, penalty: float, piece: int = 64) -> np.ndarray:
    """Labels of the best path of each sequence; ``scores`` holds the rows of all sequences one after another.

    Sequences are cut into pieces that all advance together. What a piece does to the values at its start is told by one run from each label; then the pieces of a sequence are
    chained, run again from their true values, and followed back in the same way. So the number of steps follows the piece and the number of pieces of the longest sequence."""
    n, k = len(scores), scores.shape[1]
    lengths = lengths[lengths > 0]
    if not n:
        return np.zeros(0, np.int8)
    many = -(-lengths // piece)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])  # the first piece of each sequence
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(n) - np.repeat(starts, lengths)
    place += np.repeat(first * piece, lengths)
    s = np.zeros((int(many.sum()) * piece, k))  # the end of the last piece holds rows of zeros, in which every label stays
    s[place] = scores
    s = np.ascontiguousarray(s.reshape(-1, piece, k).transpose(1, 0, 2))
    pieces = s.shape[1]
    through = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(pieces, 0)
    for t in range(piece):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + s[t][:, None, :]
    order = np.argsort(-many, kind="stable")
    running = np.searchsorted(-many[order], -np.arange(many.max()), side="left")  # sequences with more than j pieces
    begin, value = np.zeros((pieces, k)), np.zeros((len(lengths), k))
    for j, r in enumerate(running):
        at = first[order[:r]] + j
        begin[at] = value[:r]
        value[:r] = (value[:r, :, None] + through[at]).max(1)
    back, stay, v = np.zeros((piece, pieces), np.int8), np.zeros((piece, pieces, k), bool), begin
    for t in range(piece):
        back[t] = v.argmax(1)
        jump = v.max(1, keepdims=True) - penalty
        stay[t] = v >= jump
        v = np.maximum(v, jump) + s[t]
    came = np.arange(k)[None].repeat(pieces, 0)  # for each label at a piece's end the one before its start
    for t in range(piece - 1, -1, -1):
        came = np.where(np.take_along_axis(stay[t], came, 1), came, back[t][:, None])
    ends, label = np.zeros(pieces, np.int64), np.zeros(len(lengths), np.int64)
    for j in range(len(running) - 1, -1, -1):
        of = order[: running[j]]
        last, at = many[of] == j + 1, first[of] + j
        label[of] = np.where(last, v[at].argmax(1), label[of])
        ends[at] = label[of]
        label[of] = came[at, label[of]]
    labels, now = np.zeros((piece, pieces), np.int8), ends
    rows = np.arange(pieces)
    for t in range(piece - 1, -1, -1):
        labels[t] = now
        now = np.where(stay[t, rows, now], now, back[t])
    return labels.T.reshape(-1)[place]


def label_texts(model: LanguageModel, texts: list[str | None], penalty: float, with_spans: bool) -> list[dict]:
    languages, out = model.languages, []
    lower = [(t or "").lower() for t in texts]
    found = [WORD.findall(t) for t in lower]
    found = [ws if any(c.isalpha() for w in ws for c in w) else [] for ws in found]  # some signs count as word characters but are no letters
    lengths = np.array([len(w) for w in found], np.int64)
    flat = [w for ws in found for w in ws]
    if not languages or not flat:
        return [{"lang_pred": (languages or ["und"])[0] if w else "und", "score": 0.0, "n_spans": 0, "spans": []} for w in found]
    rows, scores = model.rows_of(flat)
    scores = scores[rows]
    fits = np.isfinite(scores).any(1)
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(texts)), lengths)
    inner = np.bincount(doc[fits], minlength=len(texts))
    labels = np.full(len(flat), -1, np.int8)
    labels[fits] = best_path(np.maximum(scores[fits], -1e6), inner, penalty)
    weight = np.zeros((len(texts), len(languages)))
    np.add.at(weight, (doc[fits], labels[fits]), letters[fits])
    total = np.bincount(doc, letters, len(texts))
    winner = weight.argmax(1)
    changes = np.ones(len(flat), bool)
    changes[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
    n_spans = np.bincount(doc[changes & fits], minlength=len(texts))
    ends = np.cumsum(lengths)
    for i, t in enumerate(lower):
        if not lengths[i]:
            out.append({"lang_pred": "und", "score": 0.0, "n_spans": 0, "spans": []})
            continue
        spans = []
        if with_spans:
            for m, k in zip(WORD.finditer(t), labels[ends[i] - lengths[i] : ends[i]]):
                name = languages[k] if k >= 0 else "und"
                if spans and spans[-1]["lang"] == name:
                    spans[-1]["end"] = m.end()
                else:
                    spans.append({"lang": name, "start": m.start(), "end": m.end()})
        out.append({"lang_pred": languages[winner[i]], "score": float(weight[i, winner[i]] / total[i]), "n_spans": int(n_spans[i]), "spans": spans})
    return out


def identify(model: LanguageModel, text: Column | str = "text", switch_penalty: float = 6.0, with_spans: bool = True, rows_at_once: int = 120) -> Column:
    """A struct per text: lang_pred, score (share of its letters in spans of that language), n_spans, and spans (character
    offsets into the lower-cased text; words of no learned script are ``und``)."""
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int32()), ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    @F.arrow_udf(RESULT)
    def udf(texts: pa.Array) -> pa.Array:
        got = []
        for i in range(0, len(texts), rows_at_once):
            got += label_texts(model, texts[i : i + rows_at_once].to_pylist(), switch_penalty, with_spans)
        pa.default_memory_pool().release_unused()
        return pa.array(got, kind)

    return udf(text)
