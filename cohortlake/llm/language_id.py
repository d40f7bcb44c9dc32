"""Language identification: script ranges narrow the candidates, per-word scores, and a Viterbi path with a switching penalty.

Learned from text and language names: for each language the scripts of its letters and the log-probabilities of hashed letter
trigrams (with word edges). A word's score for a language is the sum over its trigrams; languages that do not write the word's
script are ruled out for it, and a word in a script of no learned language says nothing. The best path over a text's words, where
a change of language costs a fixed penalty, labels its spans; the text's language is the one of the most letters.

Texts of a block are advanced together, one word a step, so the path costs a few array operations a step whatever the number
of texts.

Defined cases: text that is null or has no letter is "und" with score 0, as is every text if no language was learned; a text in
scripts of no learned language has score 0. Ties go to the first language by code point. Repeated rows give repeated results. Only doc_id and text are read for predictions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.common import blocks, id_remainder
from cohortlake.llm.text_models import training_rows

BUCKETS = 1 << 17
UNKNOWN = "und"
#: Cost of a change of language, in nats.
PENALTY = 12.0
RULED_OUT = -60.0

# First and last code point of the scripts' main ranges. All other letters share script 0.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(x[0] for x in SCRIPTS)]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Per code point: 0 for no letter, else 1 + its script."""
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    for name, first, last in SCRIPTS:
        part = table[first : last + 1]
        part[part > 0] = 1 + SCRIPT_NAMES.index(name)
    return table


class Words:
    """The words (runs of letters) of several texts: hashed trigrams, and for each word its first trigram, script and size."""

    def __init__(self, texts: list[str]):
        lowered = [x.lower() for x in texts]
        codes = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        kind = letters()[codes]
        at = np.flatnonzero(kind)
        self.sizes = np.zeros(0, np.int64)
        if not len(at):
            self.trigrams, self.scripts, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.per_text = np.zeros(len(texts), np.int64)
            return
        first = np.concatenate([[True], np.diff(at) > 1])
        last = np.concatenate([first[1:], [True]])
        own = codes[at]
        before = np.where(first, 0, np.concatenate([own[:1], own[:-1]])).astype(np.uint32)
        after = np.where(last, 0, np.concatenate([own[1:], own[-1:]])).astype(np.uint32)
        h = before * np.uint32(0x9E3779B1) + own * np.uint32(0x85EBCA6B) + after * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        self.trigrams = (h >> np.uint32(15)).astype(np.int64)
        self.starts = np.flatnonzero(first)
        self.sizes = np.diff(np.concatenate([self.starts, [len(at)]]))
        self.scripts = kind[at][self.starts].astype(np.int64) - 1
        ends = np.cumsum([len(x) + 1 for x in lowered])
        self.per_text = np.diff(np.concatenate([[0], np.searchsorted(at[self.starts], ends)]))


class LanguageModel:
    def __init__(self, names: list[str], scores: np.ndarray, allowed: np.ndarray):
        self.names, self.scores, self.allowed = names, scores, allowed

    @classmethod
    def learn(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        """rows of (text, language)."""
        names = sorted({x for _, x in rows})
        counts = np.full((BUCKETS, len(names)), 0.02)
        scripts = np.zeros((len(SCRIPT_NAMES), len(names)))
        for a, b in blocks([len(x) for x, _ in rows], 1 << 19):
            found = Words([x for x, _ in rows[a:b]])
            owners = np.repeat(np.array([names.index(x) for _, x in rows[a:b]]), found.per_text)
            np.add.at(scripts, (found.scripts, owners), found.sizes)
            np.add.at(counts, (found.trigrams, np.repeat(owners, found.sizes)), 1)
        scores = np.log(counts / counts.sum(axis=0)) if names else counts
        share = scripts / np.maximum(1, scripts.sum(axis=0))
        return cls(names, scores.astype(np.float32), share >= 0.005)

    def word_scores(self, found: Words) -> np.ndarray:
        scores = np.add.reduceat(self.scores[found.trigrams], found.starts, axis=0) if len(found.starts) else np.zeros((0, len(self.names)), np.float32)
        allowed = self.allowed[found.scripts]
        silent = ~allowed.any(axis=1)
        scores[silent] = 0
        return np.where(allowed | silent[:, None], scores, scores + RULED_OUT)

    def paths(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: the language of each word, each word's letters, and whether any learned language writes its script."""
        found = Words(texts)
        scores, k = self.word_scores(found), len(self.names)
        ends = np.cumsum(found.per_text)
        starts = ends - found.per_text
        order = np.argsort(-found.per_text, kind="stable")
        labels = np.zeros(len(scores), np.int16)
        for group in np.array_split(order, max(1, len(order) // 256)):
            sizes = found.per_text[group]
            sizes = sizes[sizes > 0]
            if not len(sizes):
                continue
            first, longest = starts[group[: len(sizes)]], int(sizes[0])
            came = np.zeros((longest, len(sizes), k), bool)
            winner = np.zeros((longest, len(sizes)), np.int16)
            # sizes fall along the group: after t words the first live[t] texts go on
            live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
            best = scores[first].copy()
            for t in range(1, longest):
                n = live[t]
                top = best[:n].argmax(axis=1)
                jump = best[np.arange(n), top][:, None] - PENALTY
                came[t, :n] = best[:n] < jump
                winner[t, :n] = top
                best[:n] = np.maximum(best[:n], jump) + scores[first[:n] + t]
            at = best.argmax(axis=1)
            for t in range(longest - 1, -1, -1):
                n = live[t]
                labels[first[:n] + t] = at[:n]
                if t:
                    at[:n] = np.where(came[t, np.arange(n), at[:n]], winner[t, :n], at[:n])
        heard = self.allowed[found.scripts].any(axis=1)
        return [(labels[a:b], found.sizes[a:b], heard[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def predict(self, texts: list[str]) -> list[tuple[str, float, str]]:
        """(language, its share of the letters, spans). Words in a script of no learned language follow their neighbours in the path
        but count for no language: a text of such words alone goes to the first language with score 0."""
        out: list[tuple[str, float, str]] = []
        if not self.names:
            return [(UNKNOWN, 0.0, "")] * len(texts)
        for a, b in blocks([len(x) for x in texts], 1 << 20):
            for labels, sizes, heard in self.paths(texts[a:b]):
                if not len(labels):
                    out.append((UNKNOWN, 0.0, ""))
                    continue
                total = np.bincount(labels, sizes * heard, minlength=len(self.names))
                out.append((self.names[int(total.argmax())], float(total.max() / sizes.sum()), self._written(labels)))
        return out

    def _written(self, labels: np.ndarray) -> str:
        """language:first word:end word of each span, comma-joined; words from 0, end exclusive."""
        bounds = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        return ",".join([f"{self.names[labels[a]]}:{a}:{b}" for a, b in zip(bounds, bounds[1:])])

    def spans(self, text: str) -> list[tuple[str, int]]:
        """Languages of consecutive spans and their letters."""
        out: list[tuple[str, int]] = []
        if self.names:
            labels, sizes, _ = self.paths([text])[0]
            for x, n in zip(labels.tolist(), sizes.tolist(), strict=True):
                if out and out[-1][0] == self.names[x]:
                    out[-1] = (self.names[x], out[-1][1] + n)
                else:
                    out.append((self.names[x], n))
        return out


def train_language_model(docs: DataFrame, *, per_language: int = 1000) -> LanguageModel:
    """Learn from rows with a language whose crc32(doc_id) mod 4 is not 2; at most per_language rows of each, with their whole texts."""
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").filter(id_remainder(4) != 2)
    return LanguageModel.learn([(r["text"] or "", r["lang"]) for r in training_rows(some, None, "lang", per_language)])


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, one column per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shipped.value.predict([x or "" for x in batch.column("text").to_pylist()])
            names, scores, spans = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["doc_id", "lang_pred", "score", "spans"])

    out = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans string")
    return out.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "spans")


def languages_of(docs: DataFrame, **options) -> DataFrame:
    return identify_languages(docs, train_language_model(docs, **options))
