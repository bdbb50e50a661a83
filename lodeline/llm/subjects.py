"""Subject areas of documents.

Method: averaged word and subword embeddings with independent logistic outputs. Sentences of labelled documents
are the training rows; every round each part walks its rows from the shared parameters, and the gradients it
applied are synchronised over the parts: once a round, their mean moves the parameters. A subject is given
where at least a quarter of the document's sentences are about it.

Labels are partly wrong and name documents, not sentences: from the second round on a sentence trains the one
of its document's labels that the model thinks likeliest, and is left out where the model is sure of another.

Edge cases (tests/llm/test_subjects.py): null and empty texts and texts without a sentence get no row; without
labelled documents there are no rows; repeated documents get the rows of their text; labels given twice count
once; long texts are linear in time; extra columns can't clash, as only named ones are read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.language import sentences
from lodeline.runtime import col, spread, stored

BUCKETS, DIM = 1 << 15, 24
MAX_LABELLED = 200_000  # labelled documents that train the model at most, about; the sample is by hash of the id
PART_DOCUMENTS = 2_500  # labelled documents of one training part
PARTS = (6, 64)  # fewest and most parts; their number follows from the labelled documents alone, not from the cluster
SUMMERS = 4  # tasks that add up the gradients of all parts before they reach the driver
WORD = re.compile(r"[^\W\d_]{2,}")


@lru_cache(200_000)
def features(word: str) -> tuple[int, ...]:
    """Buckets of a word, of its subwords of 4 and 5 letters with borders."""
    x = f"<{word}>"
    out = [zlib.crc32(x.encode()) % BUCKETS]
    if len(word) > 3:
        out += [zlib.crc32(x[i : i + n].encode()) % BUCKETS for n in (4, 5) for i in range(len(x) - n + 1)]
    return tuple(out)


class Rows:
    """Sentences as one array of feature ids with their places."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)])

    def __len__(self) -> int:
        return len(self.lengths)

    def take(self, order: np.ndarray) -> Rows:
        n = self.lengths[order]
        at = np.repeat(self.starts[:-1][order] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return Rows(self.ids[at], n)

    def part(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, lengths, starts) of a run of sentences."""
        return self.ids[self.starts[low] : self.starts[high]], self.lengths[low:high], self.starts[low:high] - self.starts[low]


class Model:
    def __init__(self, subjects: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.w = np.zeros((DIM, subjects), np.float32)
        self.b = np.full(subjects, -2.0, np.float32)

    def means(self, rows: Rows, low: int, high: int) -> np.ndarray:
        ids, lengths, starts = rows.part(low, high)
        return np.add.reduceat(self.e[ids], starts, axis=0) / lengths[:, None]

    def scores(self, rows: Rows) -> np.ndarray:
        """Probabilities of all sentences."""
        parts = [self.means(rows, at, min(len(rows), at + 1024)) @ self.w + self.b for at in range(0, len(rows), 1024)]
        return 1 / (1 + np.exp(-np.concatenate(parts)))

    def walk(self, rows: Rows, labels: np.ndarray, rate: float, seed: int) -> Model:
        """One pass of stochastic gradient steps with adaptive rates; the rows are shuffled by the seed."""
        order = np.random.default_rng(seed).permutation(len(rows))
        rows, labels = rows.take(order), labels[order]
        ge = np.full(BUCKETS, 1e-6, np.float32)
        gw = np.full_like(self.w, 1e-6)
        gb = np.full_like(self.b, 1e-6)
        for at in range(0, len(rows), 32):
            to = min(len(rows), at + 32)
            ids, lengths, _ = rows.part(at, to)
            x = self.means(rows, at, to)
            p = 1 / (1 + np.exp(-(x @ self.w + self.b)))
            g = (p - labels[at:to]).astype(np.float32)
            dw, db = x.T @ g, g.sum(axis=0)
            dx = ((g @ self.w.T) / lengths[:, None]).astype(np.float32)
            by = np.argsort(ids, kind="stable")
            s = ids[by]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            u = s[first]
            de = np.add.reduceat(dx[np.repeat(np.arange(to - at), lengths)[by]], first, axis=0)
            gw += dw * dw
            gb += db * db
            ge[u] += (de * de).mean(axis=1)
            self.w -= rate * dw / np.sqrt(gw)
            self.b -= rate * db / np.sqrt(gb)
            self.e[u] -= rate * de / np.sqrt(ge[u])[:, None]
        return self

    def copy(self) -> Model:
        m = object.__new__(Model)
        m.e, m.w, m.b = self.e.copy(), self.w.copy(), self.b.copy()
        return m


class Scorer:
    """Probabilities of sentences; a word's share of the outputs is kept, as words repeat."""

    def __init__(self, model: Model):
        self.e, self.w, self.b = model.e, model.w, model.b
        self.place: dict[str, int] = {}
        self.table = np.zeros((4096, len(self.b) + 1), np.float32)  # the outputs, and the number of features

    def word(self, w: str) -> int:
        at = self.place.get(w)
        if at is None:
            at = self.place[w] = len(self.place)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            ids = list(features(w))
            self.table[at, :-1], self.table[at, -1] = self.e[ids].sum(axis=0) @ self.w, len(ids)
        return at

    def __call__(self, parts: list[str]) -> np.ndarray:
        """A row for each sentence that has words."""
        if len(self.place) > 300_000:
            self.place.clear()
        at, starts = [], []
        for s in parts:
            if words := WORD.findall(s.lower()):
                starts.append(len(at))
                at += [self.word(w) for w in words]
        if not at:
            return np.zeros((0, len(self.b)), np.float32)
        x = np.add.reduceat(self.table[at], starts, axis=0)
        return 1 / (1 + np.exp(-(x[:, :-1] / x[:, -1:] + self.b)))


def train(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, subject_col: str, rounds: int = 10, rate: float = 0.15) -> tuple[Model, list[str]]:
    """Model and subject codes from the labelled documents.

    The sentences' features are computed and stored once. In a round every part makes a pass from the shared
    parameters; the gradients that it applied are summed in SUMMERS tasks and their mean moves the parameters.
    """
    marks = labels.select(col(id_col).alias("id"), col(subject_col).alias("s")).where("id is not null and s is not null").groupBy("id").agg(F.array_sort(F.collect_set("s")).alias("subjects"))
    marks = stored(marks, "marks")
    subjects = [r["s"] for r in marks.select(F.explode("subjects").alias("s")).distinct().orderBy("s").collect()]
    place = {s: i for i, s in enumerate(subjects)}
    model = Model(len(subjects))
    many = marks.count()
    if many > MAX_LABELLED:
        marks = marks.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * MAX_LABELLED / many))
    parts = min(PARTS[1], max(PARTS[0], min(many, MAX_LABELLED) // PART_DOCUMENTS))
    named = documents.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is not null").join(marks, "id")
    named = named.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.xxhash64("id", "text").alias("at"), "text", "subjects")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, at, text, names in zip(b["part"].to_pylist(), b["at"].to_pylist(), b["text"].to_pylist(), b["subjects"].to_pylist()):
                mine = [place[s] for s in names]
                for i, s in enumerate(sentences(text)):
                    if ids := [f for w in WORD.findall(s.lower()) for f in features(w)]:
                        rows.append((k, at, i, ids, mine))
            types = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["part", "at", "no", "ids", "mine"])

    rows = stored(named.repartition(parts, "part").mapInArrow(featured, "part int, at bigint, no int, ids array<int>, mine array<int>"), "features")
    shape = (BUCKETS * DIM, DIM * len(subjects), len(subjects))
    out = "n bigint, moved binary"

    def packed(n: int, moved: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([n], pa.int64()), pa.array([moved.astype(np.float32).tobytes()], pa.binary())], ["n", "moved"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            for m, x in zip(b["n"].to_pylist(), b["moved"].to_pylist()):
                y = np.frombuffer(x, np.float32)
                n, total = n + m, y if total is None else total + y
        if n:
            yield packed(n, total)

    for k in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], now: Model = model, k: int = k) -> Iterator[pa.RecordBatch]:
            tables = [pa.Table.from_batches([b]) for b in batches]
            if not tables:
                return
            every = pa.concat_tables(tables).sort_by([("part", "ascending"), ("at", "ascending"), ("no", "ascending")]).combine_chunks()
            of = every["part"].to_numpy()
            for one in np.unique(of):
                low, high = np.searchsorted(of, [one, one + 1])
                t = every.slice(low, high - low)
                ids, mine = (t[c].combine_chunks() for c in ("ids", "mine"))
                sentence = Rows(ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy()))
                labelled = np.zeros((len(sentence), len(subjects)), bool)
                labelled[np.repeat(np.arange(len(sentence)), np.diff(mine.offsets.to_numpy())), mine.flatten().to_numpy()] = True
                if k == 0:
                    y, keep = labelled, np.flatnonzero(labelled.sum(axis=1) == 1)
                else:
                    p = now.scores(sentence)
                    best = np.where(labelled, p, -1).argmax(axis=1)
                    top = p[np.arange(len(p)), best]
                    y = np.zeros_like(labelled)
                    y[np.arange(len(p)), best] = True
                    keep = np.flatnonzero((p.max(axis=1) <= 0.9) | (top >= 0.1))
                if len(keep):
                    moved = now.copy().walk(sentence.take(keep), y[keep].astype(np.float32), rate * (1 - k / rounds) + 0.01, k)
                    yield packed(len(keep), len(keep) * np.concatenate([(a - c).ravel() for a, c in ((moved.e, now.e), (moved.w, now.w), (moved.b, now.b))]))

        got = rows.mapInArrow(step, out).repartition(SUMMERS).mapInArrow(add, out).collect()  # at most SUMMERS rows of fixed size
        if not got:
            break
        mean = sum(np.frombuffer(r["moved"], np.float32) for r in got) / sum(r["n"] for r in got)
        de, dw, db = np.split(mean.astype(np.float32), np.cumsum(shape)[:2])
        model = model.copy()
        model.e, model.w, model.b = model.e + de.reshape(BUCKETS, DIM), model.w + dw.reshape(DIM, -1), model.b + db
    return model, subjects


def subject_shares(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", subject_col: str = "subject", sure: float = 0.5, least: float = 0.25) -> DataFrame:
    """(id, subject, share, confidence) of every document: the share of its sentences that are about the subject, from ``least`` on.

    A sentence is about its likeliest subject where that is at least ``sure``.
    """
    model, subjects = train(documents, labels, id_col, text_col, subject_col)
    base = spread(documents.select(col(id_col).alias("id"), col(text_col).alias("text")).where(F.col("text").rlike(r"\p{L}")))
    kind = base.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for b in batches:
            out = []
            for key, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                p = score(sentences(text)) if subjects else ()
                if not len(p):
                    continue
                top, at = p.max(axis=1), p.argmax(axis=1)
                at, top = at[top >= sure], top[top >= sure]
                for i in np.unique(at).tolist():
                    n = int((at == i).sum())
                    if n / len(p) >= least:
                        out.append((key, subjects[i], n / len(p), float(top[at == i].mean())))
            types = (b["id"].type, pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], [id_col, "subject", "share", "confidence"])

    return base.mapInArrow(judge, f"`{id_col}` {kind}, subject string, share double, confidence double")
