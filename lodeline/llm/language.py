"""Missing or wrong language labels, for documents and for the segments of mixed ones.

Method: hyperdimensional profiles. Every letter has a random bipolar vector; a trigram is the product of its
letters' vectors, permuted by position; a text is the sum of its trigrams. Language prototypes are bundles of
trigram vectors, each weighted by how far its log share in the language departs from the mean, from the rows that
carry a usable label, then once more from the sentences in the languages that the first prototypes find, so that
wrong labels lose their say. Sentences are compared with the prototypes by cosine; within a text a change of
language has its price, so that a short sentence follows its neighbours.

Bundling and the dot product are linear in the trigrams, so a sentence's cosine is summed from its trigrams'
products with the prototypes; its length is sqrt(D * sum of squared counts), as trigram vectors are
near-orthogonal.

Edge cases (tests/llm/test_language.py): where the text column is null or has no letters the fallback column
is used; where both have none the row's language is null with confidence 0; repeated rows each get their
rows; very long texts are linear in time; an empty table gives an empty result; extra columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import col, spread, stored

DIM = 4096
SMOOTH = 1e-4  # added to a trigram's share in a language, so that rare ones weigh little
SWITCH = 0.2  # evidence that a change of language between sentences costs
SUMMERS = 8  # tasks that add up the bundles of all others
# Languages and the names and codes their labels use.
NAMES = {
    "en": ("en", "eng", "english", "английский"),
    "ru": ("ru", "rus", "russian", "русский"),
    "de": ("de", "deu", "ger", "german", "deutsch", "немецкий"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "французский"),
    "es": ("es", "spa", "spanish", "español", "espanol", "испанский"),
    "uk": ("uk", "ukr", "ukrainian", "українська", "украинский"),
    "mixed": ("mixed", "mul", "multiple", "multilingual"),
}
LANGUAGES = ("en", "ru", "de", "fr", "es", "uk")
LABEL = {name: code for code, names in NAMES.items() for name in names}

SENTENCE = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+(?=[«„“\"(¿¡]*[^\W\d_a-zа-яёіїєґß-ÿ])|\n\s*\n|\n(?=[-•·–—*]\s|\d{1,3}[.)]\s)")
NOT_LETTERS = re.compile(r"[^\w]+|[\d_]+")


def canonical(label: str | None) -> str | None:
    """The code a label spells; None for none, placeholders and unknown spellings."""
    x = (label or "").strip().lower()
    return LABEL.get(x) or LABEL.get(re.split(r"[-_ (,;]", x)[0])


def sentences(text: str) -> list[str]:
    """Sentences with at least three words and twelve letters; shorter parts go to their neighbour."""
    out: list[str] = []
    short = ""
    for x in SENTENCE.split(text):
        x = (short + " " + (x or "")).strip() if short else (x or "").strip()
        short = ""
        if sum(map(str.isalpha, x)) < 12 or len(x.split()) < 3:
            short = x
        elif x:
            out.append(x)
    if short:
        if out:
            out[-1] += " " + short
        else:
            out.append(short)
    return out


class Space:
    """Random letter vectors, the same in every process."""

    def __init__(self, dim: int = DIM, seed: int = 7):
        self.dim, self.seed = dim, seed
        self.letters: dict[str, np.ndarray] = {}

    def letter(self, ch: str) -> np.ndarray:
        v = self.letters.get(ch)
        if v is None:
            v = self.letters[ch] = np.random.default_rng((self.seed, ord(ch))).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
        return v

    def grams(self, grams: list[str]) -> np.ndarray:
        """One row for each trigram."""
        out = np.empty((len(grams), self.dim), np.int8)
        for i, (a, b, c) in enumerate(grams):
            out[i] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return out


def letters(text: str) -> str:
    """Lower-case words between single spaces, without digits and marks."""
    return f" {NOT_LETTERS.sub(' ', text.lower()).strip()} "


def trigrams(text: str) -> list[str]:
    x = letters(text)
    return [x[i : i + 3] for i in range(len(x) - 2)]


class Judge:
    """Cosines of texts with the language prototypes; products of single trigrams are kept, and whole sentences, as both repeat."""

    def __init__(self, prototypes: np.ndarray, space: Space):
        norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
        self.unit, self.space = prototypes / np.where(norms == 0, 1, norms), space
        self.place: dict[str, int] = {}
        self.products = np.zeros((4096, len(prototypes)), np.float32)
        self.seen: dict[str, tuple[np.ndarray, int] | None] = {}

    def cosines(self, text: str) -> tuple[np.ndarray, int] | None:
        """Cosines and the number of trigrams; None for a text without letters."""
        x = letters(text)
        try:
            return self.seen[x]
        except KeyError:
            if len(self.seen) > 100_000:
                self.seen.clear()
            out = self.seen[x] = self._cosines(x)
            return out

    def _cosines(self, x: str) -> tuple[np.ndarray, int] | None:
        counts = Counter(x[i : i + 3] for i in range(len(x) - 2))
        if not any(ch.isalpha() for ch in x):
            return None
        new = [g for g in counts if g not in self.place]
        if new:
            if len(self.place) > 300_000:
                self.place.clear()
                new = list(counts)
            at = len(self.place)
            while at + len(new) > len(self.products):
                self.products = np.concatenate([self.products, np.zeros_like(self.products)])
            self.products[at : at + len(new)] = self.space.grams(new).astype(np.float32) @ self.unit.T.astype(np.float32)
            self.place.update(zip(new, range(at, at + len(new))))
        n = np.fromiter(counts.values(), np.float32, len(counts))
        dot = n @ self.products[[self.place[g] for g in counts]]
        return dot / np.sqrt(self.space.dim * float(n @ n)), len(x) - 2

    def document(self, text: str, switch: float) -> list[tuple[str, int, float]]:
        """(sentence, language, confidence) of the sentences that have letters."""
        parts = [(s, got) for s in sentences(text) if (got := self.cosines(s))]
        if not parts:
            return []
        cos = np.stack([c for _, (c, _) in parts])
        langs = smoothed(cos * np.sqrt([[n] for _, (_, n) in parts]), switch)
        odds = np.exp((cos - cos.max(axis=1, keepdims=True)) * 40)
        sure = odds / odds.sum(axis=1, keepdims=True)
        return [(s, k, float(sure[i, k])) for i, ((s, _), k) in enumerate(zip(parts, langs))]


def smoothed(evidence: np.ndarray, switch: float) -> list[int]:
    """The likeliest run of languages (Viterbi) for rows of evidence, where each change of language costs ``switch``.

    A text begins and ends in the language that leads it; evidence is cosine times the root of the number of
    trigrams, so a short sentence says less than a long one and follows its neighbours unless they are as weak.
    """
    rows, k = evidence.shape
    away = np.full(k, switch)
    away[int(evidence.sum(axis=0).argmax())] = 0
    score, came = evidence[0] - away, []
    for i in range(1, rows):
        top = int(score.argmax())
        stay = score >= score[top] - switch
        came.append(np.where(stay, np.arange(k), top))
        score = np.where(stay, score, score[top] - switch) + evidence[i]
    out = [int((score - away).argmax())]
    for step in reversed(came):
        out.append(int(step[out[-1]]))
    return out[::-1]


def weights(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How far the log of each language's share of a trigram departs from the mean log share; trigrams by languages."""
    x = np.log(counts / np.maximum(1, totals) + SMOOTH)
    return (x - x.mean(axis=1, keepdims=True)).astype(np.float32)


def bundle(grams: DataFrame, space: Space) -> np.ndarray:
    """Prototypes (languages x DIM) from (gram, n0, n1, ...), one count for each language, over all trigrams.

    Tasks bundle their trigrams, SUMMERS tasks add the bundles up; only those sums reach the driver.
    """
    names = [f"n{k}" for k in range(len(LANGUAGES))]
    row = grams.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    totals = np.array([float(row[n]) for n in names])
    shape = (len(LANGUAGES), space.dim)

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["bundle"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            keys = b["gram"].to_pylist()
            w = weights(np.stack([b[n].to_numpy(zero_copy_only=False) for n in names], axis=1), totals)
            for at in range(0, len(keys), 2000):
                total += w[at : at + 2000].T @ space.grams(keys[at : at + 2000]).astype(np.float32)
        yield packed(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(sum((np.frombuffer(x, np.float64).reshape(shape) for b in batches for x in b["bundle"].to_pylist()), np.zeros(shape)))

    got = grams.mapInArrow(part, "bundle binary").repartition(SUMMERS).mapInArrow(add, "bundle binary").collect()
    return sum((np.frombuffer(r["bundle"], np.float64).reshape(shape) for r in got), np.zeros(shape)).astype(np.float32)


def _text(df: DataFrame, text_col: str, fallback_col: str | None) -> F.Column:
    has = lambda c: F.when(col(c).rlike(r"\p{L}"), col(c))
    return F.coalesce(has(text_col), has(fallback_col)) if fallback_col else has(text_col)


def train(df: DataFrame, label_col: str, text_col: str, fallback_col: str | None = None, rounds: int = 2, switch: float = SWITCH) -> np.ndarray:
    """Prototypes (languages x DIM) from all rows, one pass a round: by usable labels first, then by the sentences' languages within their texts."""
    space = Space()
    rows = spread(df.select(col(label_col).alias("label"), _text(df, text_col, fallback_col).alias("text")).where("text is not null"))
    prototypes: np.ndarray | None = None
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], known: np.ndarray | None = prototypes) -> Iterator[pa.RecordBatch]:
            judge = None if known is None else Judge(known, space)
            counts: list[Counter] = [Counter() for _ in LANGUAGES]

            def flush() -> pa.RecordBatch:
                keys = list(set().union(*counts))
                out = pa.record_batch([pa.array(keys, pa.string()), *(pa.array([c[g] for g in keys], pa.int64()) for c in counts)], ["gram", *(f"n{k}" for k in range(len(counts)))])
                for c in counts:
                    c.clear()
                return out

            for b in batches:
                for label, text in zip(b["label"].to_pylist(), b["text"].to_pylist()):
                    if judge is None:
                        if (code := canonical(label)) in LANGUAGES:
                            counts[LANGUAGES.index(code)].update(trigrams(text))
                    else:
                        for s, k, _ in judge.document(text, switch):
                            counts[k].update(trigrams(s))
                if sum(map(len, counts)) > 500_000:
                    yield flush()
            yield flush()

        names = [f"n{k}" for k in range(len(LANGUAGES))]
        found = rows.mapInArrow(count, "gram string, " + ", ".join(f"{n} bigint" for n in names))
        prototypes = bundle(stored(found.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names)), "trigrams"), space)
    return prototypes


def segments(df: DataFrame, id_col: str, label_col: str, text_col: str, fallback_col: str | None = None, switch: float = SWITCH) -> DataFrame:
    """Segments of every row: (id, label, segment, start_sentence, n_sentences, text, language, confidence, document_language, document_confidence).

    Neighbouring sentences of one language are one segment (:func:`smoothed`). The document's language is
    ``mixed`` where sentences of two languages stand in it.
    """
    prototypes = train(df, label_col, text_col, fallback_col, switch=switch)
    rows = spread(df.select(col(id_col).alias("id"), col(label_col).alias("label"), _text(df, text_col, fallback_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    names = [id_col, "label", "segment", "start_sentence", "n_sentences", "text", "language", "confidence", "document_language", "document_confidence"]

    def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(prototypes, Space())
        for b in batches:
            out = []
            for key, label, text in zip(b["id"].to_pylist(), b["label"].to_pylist(), b["text"].to_pylist()):
                parts = judge.document(text or "", switch)
                if not parts:
                    out.append((key, label, 0, 0, 0, text, None, 0.0, None, 0.0))
                    continue
                langs = [k for _, k, _ in parts]
                sure = [p for _, _, p in parts]
                whole = LANGUAGES[langs[0]] if len(set(langs)) == 1 else "mixed"
                at = n = 0
                while at < len(parts):
                    to = at
                    while to < len(parts) and langs[to] == langs[at]:
                        to += 1
                    out.append((key, label, n, at, to - at, " ".join(p[0] for p in parts[at:to]), LANGUAGES[langs[at]], float(np.mean(sure[at:to])), whole, float(np.mean(sure))))
                    at, n = to, n + 1
            types = [b["id"].type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names)

    return rows.mapInArrow(judge_rows, f"`{id_col}` {kind}, label string, segment int, start_sentence int, n_sentences int, text string, language string, confidence double, document_language string, document_confidence double")


def wrong_labels(found: DataFrame) -> DataFrame:
    """Segments of the documents whose label is missing, a placeholder or wrong; another spelling of the right label is right."""
    x = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    known = F.create_map(*(F.lit(y) for pair in LABEL.items() for y in pair))
    code = F.coalesce(known[x], known[F.split(x, r"[-_ (,;]")[0]])
    return found.where(F.col("language").isNotNull() & ~code.eqNullSafe(F.col("document_language")))
