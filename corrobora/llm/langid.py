"""Language identification in two steps: family, then language.

Texts become relative frequencies of hashed byte trigrams, capitals A-Z as small
letters and every other ASCII byte as a gap.  Linear support vector machines vote
one against one, first between language families, then between the languages of
the family that won.  They are fitted on a bounded sample of the learning part;
all else covers whole texts of all rows.

Defined results: ``und`` with score 0 for a null text or one without a letter, and
for every text when nothing can be learned from; a text too short for a trigram
gets the decision of the biases; repeated rows are predicted one by one; the
prediction reads no column but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.kernel import LOWER, flat, runs

# Well-known languages by family (ISO 639-1).  A language that is
# not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nb nn no sv yi".split(),
    "romance": "ca es fr gl it la oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "indo-aryan": "bn gu hi mr ne pa ur".split(),
    "iranian": "fa ku ps tg".split(),
    "turkic": "az kk ky tr tk tt uz".split(),
    "uralic": "et fi hu".split(),
    "semitic": "am ar he mt".split(),
    "baltic": "lt lv".split(),
    "celtic": "br cy ga gd".split(),
    "sinitic": "zh yue".split(),
    "dravidian": "kn ml ta te".split(),
    "austronesian": "id jv mg ms su tl".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


@dataclass(frozen=True)
class LangSpec:
    """At most ``sample`` texts are learned from, equally many of each language."""

    held_out_of: int = 4
    held_out: int = 2
    sample: int = 2_400
    bits: int = 12
    rounds: int = 150
    ridge: float = 1e-3


_CODE = np.where((LOWER >= 0x61) & (LOWER <= 0x7A) | (LOWER >= 0x80), LOWER, 0x20).astype(np.uint32)
_TIMES = np.uint32(0x9E3779B1)


def trigram_counts(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Counts of the hashed trigrams of each row; those of gaps alone are left out."""
    data, offsets = flat(column)
    for low, high in runs(offsets):
        code = _CODE[data[offsets[low]:offsets[high]]]
        bounds = (offsets[low:high + 1] - offsets[low]).tolist()
        value = code[:-2] | code[1:-1] << np.uint32(8) | code[2:] << np.uint32(16)
        slot = ((value ^ value >> np.uint32(11)) * _TIMES) >> np.uint32(32 - bits)
        some = value != 0x202020
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield np.bincount(slot[a:b - 2][some[a:b - 2]] if b - a > 2 else slot[:0], minlength=1 << bits)


def learning_rows(docs: DataFrame, spec: LangSpec) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, language number of each sampled text, trigram counts)."""
    remainder = F.crc32(F.col("doc_id").cast("string")) % spec.held_out_of
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.coalesce(remainder, F.lit(0)) != spec.held_out))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    each = max(1, spec.sample // max(1, len(langs)))
    # A seeded hash thins every language to about ``each`` rows; the limit makes the bound sure.
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id", F.crc32("text")), F.lit(1 << 30)) / float(1 << 30)
    part = F.lit(0.0)
    for lang in langs:
        part = F.when(F.col("lang") == lang, each / sizes[lang]).otherwise(part)
    chosen = known.where(draw < part).select("lang", "text").limit(2 * spec.sample)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = list(trigram_counts(batch.column("text"), spec.bits))
            slots = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array([s.astype(np.uint16).tobytes() for s in slots], pa.binary()),
                 pa.array([c[s].astype(np.float32).tobytes() for c, s in zip(counts, slots)], pa.binary())], names=["lang", "slots", "counts"])

    rows = chosen.mapInArrow(task, "lang string, slots binary, counts binary").collect()
    x = np.zeros((len(rows), 1 << spec.bits), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["slots"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    number = {lang: i for i, lang in enumerate(langs)}
    return langs, np.array([number[r["lang"]] for r in rows], int), x


def fit_svm(x: np.ndarray, y: np.ndarray, spec: LangSpec) -> np.ndarray:
    """Weights, bias last, of a linear machine with squared hinge loss; ``y`` is -1 or 1, both sides weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    ahead, speed = w.copy(), 1.0
    step = 1.0 / (2 * float((share * (x ** 2).sum(1)).sum()) + spec.ridge)
    for _ in range(spec.rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = -2 * ((share * slack * y) @ x) + spec.ridge * ahead
        new = ahead - step * gradient
        faster = (1 + np.sqrt(1 + 4 * speed ** 2)) / 2
        ahead, w, speed = new + (speed - 1) / faster * (new - w), new, faster
    return w


class Identifier:
    """Families, their languages, and the machines between each two of them."""

    def __init__(self, langs: list[str], label: np.ndarray, counts: np.ndarray, spec: LangSpec):
        present = [i for i in range(len(langs)) if (label == i).any()]
        self.langs = langs
        self.members: dict[str, list[int]] = {}
        for i in present:
            self.members.setdefault(FAMILY_OF.get(langs[i], langs[i]), []).append(i)
        self.families = sorted(self.members)
        rate = counts / np.maximum(1, counts.sum(1, keepdims=True))
        self.scale = 1 / np.sqrt(rate.mean(0) + 1e-5) if len(rate) else np.ones(1 << spec.bits)
        x = (rate * self.scale).astype(np.float32)
        family = np.array([self.families.index(FAMILY_OF.get(langs[i], langs[i])) for i in label], int)
        self.family_pairs = list(combinations(range(len(self.families)), 2))
        self.lang_pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        weights = [fit_svm(x[np.isin(g, p)], np.where(g[np.isin(g, p)] == p[1], 1, -1).astype(np.float32), spec)
                   for g, pairs in ((family, self.family_pairs), (label, self.lang_pairs)) for p in pairs]
        self.weights = np.array(weights, np.float32).reshape(len(weights), -1).T if weights else np.zeros(((1 << spec.bits) + 1, 0), np.float32)
        self.weights[:-1] *= self.scale[:, None]

    @staticmethod
    def _vote(pairs: list[tuple[int, int]], margins: np.ndarray, among: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(winner, score) of each row: most duels won, then the largest sum of margins."""
        place = {c: i for i, c in enumerate(among)}
        sure = 1 / (1 + np.exp(-4 * np.clip(margins, -10, 10)))
        wins, sums, least = np.zeros((len(margins), len(among))), np.zeros((len(margins), len(among))), np.ones((len(margins), len(among)))
        for k, (a, b) in enumerate(pairs):
            a, b, m, s = place[a], place[b], margins[:, k], sure[:, k]
            wins[:, b] += m > 0
            wins[:, a] += m <= 0
            sums[:, b] += m
            sums[:, a] -= m
            least[:, b], least[:, a] = np.minimum(least[:, b], s), np.minimum(least[:, a], 1 - s)
        best = np.argmax(wins + sums / (1 + np.abs(sums).max(initial=0)) / 2, axis=1)
        return best, least[np.arange(len(best)), best]

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score) of each row of trigram counts."""
        rate = counts / np.maximum(1, counts.sum(1, keepdims=True))
        margins = rate.astype(np.float32) @ self.weights[:-1] + self.weights[-1]
        family, score = self._vote(self.family_pairs, margins[:, :len(self.family_pairs)], list(range(len(self.families))))
        lang, score = np.empty(len(counts), object), score.copy()
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            among = self.members[name]
            columns = [len(self.family_pairs) + k for k, p in enumerate(self.lang_pairs) if p[0] in among]
            best, sure = self._vote([self.lang_pairs[c - len(self.family_pairs)] for c in columns], margins[np.ix_(rows, columns)], among)
            lang[rows] = np.array([self.langs[i] for i in among], object)[best]
            score[rows] *= sure
        return lang.tolist(), score


def _predicted(tables, bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tables.value
        for batch in batches:
            langs, scores, waiting = [], [], []
            for counts in trigram_counts(batch.column("text"), bits):
                waiting.append(counts)
                if len(waiting) == 128:
                    lang, score = model.predict(np.array(waiting))
                    langs, scores, waiting = langs + lang, [*scores, *score], []
            if waiting:
                lang, score = model.predict(np.array(waiting))
                langs, scores = langs + lang, [*scores, *score]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lettered"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lettered", "lang_pred", "score"])
    return task


def identify(docs: DataFrame, spec: LangSpec = LangSpec()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of ``docs(doc_id, text, lang)``."""
    held_out: Column = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % spec.held_out_of == spec.held_out, F.lit(False))
    langs, label, counts = learning_rows(docs, spec)
    if not len(label):
        return docs.select("doc_id", held_out.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    tables = docs.sparkSession.sparkContext.broadcast(Identifier(langs, label, counts, spec))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    rows = rows.mapInArrow(_predicted(tables, spec.bits), f"doc_id {kind}, lettered boolean, lang_pred string, score double")
    return rows.select("doc_id", held_out.alias("held_out"), F.when(F.col("lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
                       F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))
