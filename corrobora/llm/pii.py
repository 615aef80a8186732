"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns of the four kinds give base spans, which always stay.  The field then labels the
other words that could be personal data, ``none`` or one of the kinds:

* Nodes are the words of a text.  Words in base spans keep their kind, and words without a
  digit, without ``@`` and unlike the name of any address in the text are none; messages from
  such fixed words are constants, so only the others are computed.
* Neighbouring words share a transition potential.  Distant words that are repeated (the
  same digits, the same letters) or similar (digits within those of a base span, the
  name of an address) share a skip potential.
* Loopy message passing on all of a text's edges gives each word's label.  A word is linked with
  the word before it of the same key and with one base span, so edges grow with the text.

Weights come from the patterns' own matches: pseudolikelihood, one example a word, on at
most ``sample`` words of each label, drawn by hash from all texts.  The sign that
decides for a pattern (``+``) is no feature, so that words without it are recognised.  Skip
weights start from ``agreement`` and are learned from repeated words.

Defined results: a null or empty text has no spans; equal rows and rows without an id keep
rows of their own; without any base span in the corpus nothing is added; an empty table
gives an empty table; other columns are left behind.  A task holds one whole text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

# Kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGIT = re.compile("[0-9]")

NONE = 0                    # labels: none, then the kinds
LABELS = 1 + len(KINDS)
Span = tuple[int, int, int]


@dataclass(frozen=True)
class PiiSpec:
    """Learning rows a label, hashed features, prior agreement of linked words, and message rounds."""

    sample: int = 2_000
    slots: int = 1 << 12
    agreement: float = 8.0
    #: prior log odds that a word which no pattern took is personal data
    doubt: float = -2.0
    rounds: int = 30
    steps: int = 300
    shrink: float = 1e-4
    shortest_key: int = 6


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    doubled = (2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``local@domain.tld``, from the signs ``@`` outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain and at > free and text[at - 1] in LOCAL:
            start = at - 1
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    return out


def _matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Matches of the patterns by kind, then start, and whether each passes its checks."""
    for span in emails(text):
        yield (1, *span), True
    for m in IP.finditer(text):
        yield (2, *m.span()), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        yield (3, *m.span()), 16 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield (4, *m.span()), 8 <= len(DIGIT.findall(m.group())) <= 15


def base_spans(text: str) -> list[Span]:
    """(label, start, end) of the matches that pass, by kind, then start."""
    return [span for span, fine in _matches(text) if fine]


def doubtful_spans(text: str) -> list[Span]:
    """Matches that fail their checks, long enough to hold personal data; their words teach nothing."""
    return [span for span, fine in _matches(text) if not fine and len(DIGIT.findall(text, *span[1:])) >= 8]


def _digits(word: str) -> str:
    return "".join(DIGIT.findall(word))


def _shape(word: str) -> str:
    """The word with its signs but ``+``, digit runs by length, letters as one."""
    word = re.sub(r"[^\W\d_]+", "a", word.strip("\"'[]{}<>,.;:!?").replace("+", ""))
    return re.sub("[0-9]+", lambda m: f"{min(len(m.group()), 20)}", word) if len(word) <= 64 else "long"


def _numeric(word: str) -> bool:
    return bool(DIGIT.search(word)) and len(word) <= 64 and not re.search(r"[^\W\d_]", word)


class Field:
    """The words of one text: fixed labels, open words, their features and edges."""

    def __init__(self, text: str, base: list[Span], spec: PiiSpec):
        self.words = [m.span() for m in WORD.finditer(text)]
        self.text, self.spec = text, spec
        self.starts, self.ends = [w[0] for w in self.words], [w[1] for w in self.words]
        self.label: dict[int, int] = {}
        self.keys: dict[str, int] = {}          # digits within, and names of, base spans: a word of the first one
        for label, start, end in base:
            inside = self.within(start, end)
            for i in inside:
                self.label.setdefault(i, label)
            if label == 1:
                name = text[start:text.index("@", start)].lower()
                if re.search(r"[0-9._%+-]", name.strip("._%+-")):
                    self.keys.setdefault(name, inside[0])
            else:
                digits, least = _digits(text[start:end]), spec.shortest_key
                for i in range(len(digits) - least + 1):
                    for j in range(i + least, len(digits) + 1):
                        self.keys.setdefault(digits[i:j], inside[0])
        self.open = [i for i in range(len(self.words)) if i not in self.label and self._may(self.word(i))]

    def within(self, start: int, end: int) -> range:
        """Words that a span touches."""
        return range(bisect_right(self.ends, start), bisect_left(self.starts, end))

    def word(self, i: int) -> str:
        return self.text[slice(*self.words[i])] if 0 <= i < len(self.words) else ""

    def _may(self, word: str) -> bool:
        return "@" in word or bool(DIGIT.search(word)) or word.strip("\"'()[]{}<>,.;:!?").lower() in self.keys

    def key(self, i: int) -> str | None:
        """What makes a word similar to others: its digits if there are enough, else its letters if they name an address."""
        digits = _digits(self.word(i))
        if len(digits) >= self.spec.shortest_key:
            return digits
        name = self.word(i).strip("\"'()[]{}<>,.;:!?").lower()
        return name if name in self.keys else None

    def features(self, i: int) -> list[int]:
        """Slots of the word's shape, digits, checks and surroundings."""
        word, before, after = self.word(i), self.word(i - 1), self.word(i + 1)
        digits = _digits(word)
        groups = re.findall("[0-9]+", word)
        quad = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
        first, last = i, i
        while i - first < 8 and _numeric(self.word(first - 1)):
            first -= 1
        while last - i < 8 and _numeric(self.word(last + 1)):
            last += 1
        phrase = sum(len(_digits(self.word(j))) for j in range(first, last + 1)) if _numeric(word) else 0
        named = ["", f"shape {_shape(word)}", f"digits {min(len(digits), 20)}", f"phrase {min(phrase, 40)}", f"quad {quad}",
                 f"check {13 <= len(digits) <= 19 and luhn(digits)}", f"at {'@' in word} {'.' in word.rpartition('@')[2].strip('.')}",
                 f"before {_shape(before) if _numeric(before) else ''}", f"after {_shape(after) if _numeric(after) else ''}",
                 f"word {re.sub(r'[^a-z]', '', before.lower())[:24]}"]
        return [zlib.crc32(f.encode()) % self.spec.slots for f in named]

    def chained(self, i: int) -> list[int]:
        """Labels of the fixed or known words beside word i; an edge of the text is none."""
        return [self.label.get(i - 1, NONE), self.label.get(i + 1, NONE)]

    def links(self) -> tuple[list[tuple[int, int]], dict[int, int]]:
        """(edges of open words of one key, the base label that an open word is linked with)."""
        last: dict[str, int] = {}
        edges, fixed = [], {}
        for i in self.open:
            key = self.key(i)
            if key is None:
                continue
            if key in last:
                edges.append((last[key], i))
            last[key] = i
            if key in self.keys:
                fixed[i] = self.label[self.keys[key]]
        return edges, fixed


@dataclass(frozen=True)
class Weights:
    """Node weights by feature slot, transition and skip potentials."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _messages(unary: np.ndarray, edges: np.ndarray, pairs: np.ndarray, rounds: int) -> np.ndarray:
    """Loopy beliefs: ``unary[node, label]`` logs, ``edges[e] = (a, b)`` with potentials ``pairs[e, label a, label b]``."""
    if not len(edges):
        return unary
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([pairs, pairs.transpose(0, 2, 1)])
    back = np.roll(np.arange(len(source)), len(edges))
    sent = np.zeros((len(source), unary.shape[1]))
    belief = unary
    for _ in range(rounds):
        inner = (belief[source] - sent[back])[:, :, None] + table
        new = np.logaddexp.reduce(inner, axis=1)
        new -= new.max(axis=1, keepdims=True)
        new = (new + sent) / 2                      # damped, so that loops settle
        moved = np.abs(new - sent).max()
        sent = new
        belief = unary.copy()
        np.add.at(belief, target, sent)
        if moved < 1e-4:
            break
    return belief


def added_spans(text: str, base: list[Span], weights: Weights, spec: PiiSpec) -> list[Span]:
    """Spans that the field finds beside the base spans."""
    field = Field(text, base, spec)
    if not field.open:
        return []
    number = {i: n for n, i in enumerate(field.open)}
    unary = weights.node[np.array([field.features(i) for i in field.open])].sum(axis=1)
    unary[:, 1:] += spec.doubt
    skips, fixed = field.links()
    for i, n in number.items():
        if i - 1 not in number:
            unary[n] += weights.chain[field.label.get(i - 1, NONE)]
        if i + 1 not in number:
            unary[n] += weights.chain[:, field.label.get(i + 1, NONE)]
        if i in fixed:
            unary[n] += weights.skip[fixed[i]]
    beside = [(number[i], number[i + 1]) for i in field.open if i + 1 in number]
    edges = np.array(beside + [(number[a], number[b]) for a, b in skips], np.int64).reshape(-1, 2)
    pairs = np.concatenate([np.repeat(weights.chain[None], len(beside), 0), np.repeat(weights.skip[None], len(skips), 0)])
    best = _messages(unary, edges, pairs, spec.rounds).argmax(axis=1).tolist()
    out, i = [], 0
    while i < len(best):
        j = i + 1
        if best[i] > 2:                             # cards and phone numbers may have several words
            while j < len(best) and best[j] == best[i] and field.open[j] == field.open[j - 1] + 1 and "+" not in field.word(field.open[j]):
                j += 1
        if best[i] != NONE:
            out.append((best[i], *_trimmed(text, best[i], field.words[field.open[i]][0], field.words[field.open[j - 1]][1])))
        i = j
    return out


def _trimmed(text: str, label: int, start: int, end: int) -> tuple[int, int]:
    """A span without the signs around it: numbers reach from their first to their last digit."""
    part = text[start:end]
    if label == 1 or not DIGIT.search(part):
        inner = part.strip("\"'()[]{}<>,.;:!?")
        start += part.index(inner)
        return start, start + len(inner)
    first = DIGIT.search(part).start()
    if label == 4:
        while first and part[first - 1] in "+(":
            first -= 1
    return start + first, end - (len(part) - max(m.end() for m in DIGIT.finditer(part)))


def _examples(spec: PiiSpec):
    """Task function: a row for each word that could be personal data, with its label and its neighbours'."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in ("label", "draw", "slots", "beside", "linked")}
            for text in _candidates(batch.column("text")):
                field = Field(text, base_spans(text), spec)
                keys: dict[str, int] = {}
                unsure = {i for _, start, end in doubtful_spans(text) for i in field.within(start, end) if i not in field.label}
                for i in sorted({*field.open, *field.label} - unsure):
                    key, own = field.key(i), field.label.get(i, NONE)
                    linked = keys.get(key, -1) if key else -1
                    if key:
                        keys[key] = own
                    for c, x in zip(rows, (own, zlib.crc32(f"{i} {text[:200]} {len(text)}".encode()), field.features(i), field.chained(i), linked)):
                        rows[c].append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["label"], pa.int32()), pa.array(rows["draw"], pa.int64()), pa.array(rows["slots"], pa.list_(pa.int32())),
                 pa.array(rows["beside"], pa.list_(pa.int32())), pa.array(rows["linked"], pa.int32())], names=list(rows))
    return task


def _candidates(column: pa.Array) -> Iterator[str]:
    """The texts with a digit or an ``@``; only they can hold spans."""
    yield from column.filter(pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False)).to_pylist()


def learn(docs: DataFrame, spec: PiiSpec = PiiSpec()) -> Weights | None:
    """Weights from the patterns' matches in ``docs(text)``; None without any."""
    words = docs.select("text").mapInArrow(_examples(spec), "label int, draw long, slots array<int>, beside array<int>, linked int")
    order = Window.partitionBy("label").orderBy("draw", "slots", "beside", "linked")
    rows = (words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= spec.sample)
            .orderBy("label", "rank").collect())
    y = np.array([r.label for r in rows], np.int64)
    if not (y > 0).any():
        return None
    slots, beside = np.array([r.slots for r in rows]), np.array([r.beside for r in rows])
    linked = np.array([r.linked for r in rows])
    has = linked >= 0
    prior = spec.agreement * np.eye(LABELS)
    w = [np.zeros((spec.slots, LABELS)), np.zeros((LABELS, LABELS)), prior.copy()]
    first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    truth = np.eye(LABELS)[y]
    for step in range(1, spec.steps + 1):
        node, chain, skip = w
        score = node[slots].sum(axis=1) + chain[beside[:, 0]] + chain[:, beside[:, 1]].T
        score[has] += skip[linked[has]]
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        miss = (p / p.sum(axis=1, keepdims=True) - truth) / len(y)
        slopes = [spec.shrink * node, spec.shrink * chain, spec.shrink * (skip - prior)]
        np.add.at(slopes[0], slots.ravel(), np.repeat(miss, slots.shape[1], axis=0))
        np.add.at(slopes[1], beside[:, 0], miss)
        np.add.at(slopes[1].T, beside[:, 1], miss)
        np.add.at(slopes[2], linked[has], miss[has])
        for k, g in enumerate(slopes):              # Adam
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - 0.1 * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Weights(*w)


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k - 1]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, spec: PiiSpec = PiiSpec()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts and digest of the base spans, and all spans.

    Offsets are code points, ends exclusive; spans are listed by kind, then start.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"n_{k}" for k in KINDS]
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs, spec))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n, column = batch.num_rows, batch.column("text")
            counts, digests, spans = np.zeros((n, len(KINDS)), np.int64), [nothing] * n, [""] * n
            some = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_numpy(zero_copy_only=False))
            for i, text in zip(some.tolist(), _candidates(column)):
                base = base_spans(text)
                for label, _, _ in base:
                    counts[i, label - 1] += 1
                digests[i] = hashlib.sha256(_written(base).encode()).hexdigest()
                spans[i] = _written(base + (added_spans(text, base, weights.value, spec) if weights.value else []))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts.T.copy()), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *names, "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        task, f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, base_sha256 string, spans string")
