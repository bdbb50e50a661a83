"""Text decoded with the wrong character encoding: find it and restore it.

Method: values whose ASCII skeleton is equal are twins of one original. Each is aligned, character run by
character run, with the most plausible of its twins; a transformation (written in encoding A, read in encoding
B) that turns one exactly into the other is learned once it explains enough characters, and where no encodings
fit, the map of characters itself is. The learned transformations, undone alone or
one after the other, are then tried on every non-ASCII token of every record; a letter-bigram model of the
corpus decides between a token and its repaired forms.

Edge cases (tests/llm/test_encoding.py): null and empty values give no row; U+FFFD and C1 control
characters mark a value as garbled even where nothing can be restored (``repaired`` keeps what is
recoverable, ``recovered`` is false); repeated rows each get their row; an empty table gives an empty
result; extra columns are left alone and never clash, as only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import col, spread, stored

# Encodings that text may have been written in, and those it may have been read in.
WRITTEN = ("utf-8", "cp1251", "koi8-r", "koi8-u", "cp866", "cp1252", "mac_cyrillic")
READ = ("cp1252", "latin-1", "cp1251", "mac_roman", "koi8-r", "cp866", "cp437")

NON_ASCII = re.compile(r"[^\x00-\x7f]+")
TOKEN = re.compile(r"[^ \n]+")
EIGHT = re.compile(rb"(?:[^A-Za-z0-9]*[A-Za-z0-9]){8}")
DIGITS = re.compile(r"[0-9]+")
LOST = re.compile(r"[�\x80-\x84\x86-\x9f]|[^\W_]\?[^\W\d_]|[^\W\d_]\?’|(?<!\S)\?[^\W\d_]")
MIXED = re.compile(r"[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]")
PROOF = 4  # characters that a transformation has to explain, counted once for each pair of twins
LEAST_MAP = 6  # different characters that a learned map changes at least
NEVER = -16.0


def as_bytes(text: str, read: str) -> bytes | None:
    """The bytes that ``text`` was read from under ``read``; holes of a code page are read as control characters."""
    if read == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    try:
        return text.encode(read)
    except UnicodeEncodeError:
        out = bytearray()
        for ch in text:
            try:
                out += ch.encode(read)
            except UnicodeEncodeError:
                if not 0x80 <= ord(ch) < 0xA0:
                    return None
                out.append(ord(ch))
        return bytes(out)


def undo(text: str, written: str, read: str) -> str | None:
    raw = as_bytes(text, read)
    if raw is None:
        return None
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        return None


def twin_keys(value: str) -> list[bytes]:
    """What equal originals share, however they were decoded: the ASCII part, and the ASCII part with a mark for every other character."""
    ascii_part = value.encode("ascii", "ignore")
    keys = [b"a" + ascii_part] if EIGHT.match(ascii_part) else []
    if len(value) - len(ascii_part) >= 12:
        keys.append(b"b" + value.encode("ascii", "replace"))
    return keys


def tokens_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def transformations(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Transformations that explain every aligned run of the two twins."""
    a, b = NON_ASCII.findall(garbled), NON_ASCII.findall(clean)
    if len(a) != len(b):
        return []
    out = []
    for written in WRITTEN:
        raw = [as_bytes(x, written) for x in b]
        if None in raw:
            continue
        out += [(written, read) for read in READ if read != written and all(as_bytes(x, read) == y for x, y in zip(a, raw))]
    return out


class _Symbols(dict):
    """Characters of the code pages stand for themselves, all others for their block of 256, so that bigrams are bounded whatever scripts a corpus has."""

    def __init__(self):
        super().__init__({k: k for k in range(0x80)})
        for page in {*WRITTEN, *READ} - {"utf-8"}:
            for k in range(0x80, 0x100):
                ch = bytes([k]).decode(page, "ignore")
                self.update({ord(x): ord(x) for c in ch for x in (c, *c.lower())})

    def __missing__(self, k: int) -> int:
        self[k] = out = k & ~0xFF
        return out


SYMBOLS = _Symbols()


def bigrams(token: str) -> Iterator[str]:
    """Neighbouring symbols of a token in lower case, where one of the two is beyond ASCII."""
    for a, b in pairwise(f" {DIGITS.sub('0', token.lower())} ".translate(SYMBOLS)):
        if a > "\x7f" or b > "\x7f":
            yield a + b


class Letters:
    """Character-bigram model of the corpus: mean log frequency of a token's bigrams."""

    def __init__(self, counts: dict[str, int]):
        total = max(1, sum(counts.values()))
        self.logs = {k: math.log(v / total) - 5.5 * sum(not ord(ch) & 0xFF for ch in k) for k, v in counts.items()}  # log 256 for a character of a block
        self.known = {ch for k, v in counts.items() if v >= 3 for ch in k}
        self.blocks = {ord(ch) >> 8 for ch in self.known if ch.isalpha() or not ord(ch) & 0xFF}

    def score(self, token: str) -> tuple[float, int]:
        got = [self.logs.get(x, NEVER) for x in bigrams(token)]
        return (sum(got) / len(got) if got else 0.0), len(got)

    def whole(self, text: str) -> float:
        """Mean over all bigrams of a text's distinct tokens."""
        got = [self.score(t) for t in set(tokens_of(text)) if not t.isascii()]
        return sum(x * n for x, n in got) / max(1, sum(n for _, n in got))

    def plausible(self, run: str) -> bool:
        """Every letter is of an alphabet that the corpus uses."""
        return all(not ch.isalpha() or ord(ch) >> 8 in self.blocks for ch in run)


def swap_table(written: str, read: str) -> dict[int, str]:
    """Single characters undone: what a byte gives in ``read`` to what it gives in ``written``."""
    out = {}
    for k in range(0x80, 0x100):
        try:
            right = bytes([k]).decode(written)
        except UnicodeDecodeError:
            continue
        try:
            out[ord(bytes([k]).decode(read))] = right
        except UnicodeDecodeError:
            out[k] = right
    return out


class Repairer:
    """Verdict on single tokens; tokens repeat, so verdicts are kept."""

    def __init__(self, counts: dict[str, int], learned: list[tuple[str, str]], maps: dict[str, dict[str, str]] | None = None, margin: float = 2.0, least: float = 6.0):
        self.letters, self.margin, self.least = Letters(counts), margin, least
        self.wide = [r for w, r in learned if w == "utf-8"]
        self.swaps = {f"{w}<{r}": swap_table(w, r) for w, r in learned if w != "utf-8"}
        self.swaps |= {name: {ord(k): v for k, v in m.items()} for name, m in (maps or {}).items()}
        self.seen: dict[str, tuple[str, str, bool, bool] | None] = {}

    def token(self, token: str) -> tuple[str, str, bool, bool] | None:
        """(repaired, what was undone, whether that proves itself, whether characters are lost); None if all is well."""
        try:
            return self.seen[token]
        except KeyError:
            if len(self.seen) > 300_000:
                self.seen.clear()
            lost = bool(LOST.search(token))
            got = self._token(token) if not token.isascii() else (token, "", False)
            self.seen[token] = out = (*got, lost) if lost or got[1] else None
            return out

    def _wide(self, token: str, read: str) -> str | None:
        """Undo UTF-8 read as ``read`` wherever it is certain: whole runs that are valid UTF-8 of known characters."""
        hit = False

        def run(m: re.Match) -> str:
            nonlocal hit
            x = m.group()
            y = undo(x, "utf-8", read) if len(x) > 1 else None
            if y is None or len(y) >= len(x) or not self.letters.plausible(y):
                return x
            hit = True
            return y

        out = NON_ASCII.sub(run, token)
        return out if hit else None

    def _token(self, token: str) -> tuple[str, str, bool]:
        best, how = token, ""
        for _ in range(3):
            found = None
            for read in self.wide:
                if (x := self._wide(best, read)) is not None and (found is None or self._rank(x) > self._rank(found)):
                    found = x
            if found is None:
                break
            best, how = found, "utf-8"
        here, n = self.letters.score(best)
        top, score, swap = "", NEVER, ""
        tried = {best}
        if n >= 2:
            for name, table in self.swaps.items():
                x = best.translate(table)
                if x not in tried:
                    tried.add(x)
                    if (y := self.letters.score(x)[0]) > score:
                        top, score, swap = x, y, name
        mixed = bool(MIXED.search(best)) and not MIXED.search(top)
        ease = 0.5 if mixed else 1.0
        if score > here + self.margin * ease and (score - here) * n >= self.least * ease:
            return top, swap, bool(how) or mixed or sum(ch > "\x7f" for ch in best) >= 3
        return best, how, bool(how)

    def _rank(self, token: str) -> tuple:
        return (-sum(ch not in self.letters.known and not ch.isascii() for ch in token.translate(SYMBOLS)), self.letters.score(token)[0], -len(token))

    def rest(self, tokens: set[str], swaps: list[dict[int, str]]) -> Iterator[tuple[str, str]]:
        """Tokens beside proven ones that read better after the same swap, by however little."""
        for t in tokens:
            if not t.isascii():
                x = max((t.translate(s) for s in swaps), key=lambda y: self.letters.score(y)[0])
                if self.letters.score(x)[0] > self.letters.score(t)[0]:
                    yield t, x

    def value(self, text: str) -> tuple[str, bool, bool]:
        """Repaired text, garbled, recovered whole. A swap of single characters counts only beside a proven one."""
        odd = {t: got for t in set(tokens_of(text)) if (got := self.token(t)) is not None}
        if not odd:
            return text, False, False
        proven = {how for _, how, strong, _ in odd.values() if strong}
        fix = {t: new for t, (new, how, strong, _) in odd.items() if how and (strong or how in proven)}
        if swaps := [self.swaps[how] for how in proven if how in self.swaps]:
            fix.update(self.rest(set(tokens_of(text)) - fix.keys(), swaps))
        out = TOKEN.sub(lambda m: fix.get(m.group(), m.group()), text) if fix else text
        lost = any(x[3] for x in odd.values())
        return out, bool(fix) or lost, bool(fix) and not LOST.search(out)


def _fields(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(id, field, value) of the fields that hold any character beyond ASCII or a lost one; the rest can't be garbled."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), col(f).alias("value")) for f in fields)))
    return (
        df.select(col(id_col).alias("id"), each.alias("x"))
        .select("id", "x.field_name", "x.value")
        .where(F.col("value").rlike(r"[^\x00-\x7F]|\?\p{L}"))
    )


_SURVEY = ["kind", "key", "ref", "field_name", "n"]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Character bigrams of the partition (kind g, key is the bigram) and the twin keys of each distinct value (kind k, n is the value's hash)."""
    words: Counter = Counter()
    seen: set[int] = set()
    kind = pa.string()

    def flush() -> pa.RecordBatch:
        grams: Counter = Counter()
        for token, n in words.items():
            if not token.isascii():
                for x in bigrams(token):
                    grams[x] += n
        words.clear()
        m = len(grams)
        return pa.record_batch([pa.array(["g"] * m, pa.string()), pa.array(grams, pa.string()), pa.nulls(m, kind), pa.nulls(m, pa.string()), pa.array(grams.values(), pa.int64())], _SURVEY)

    for b in batches:
        kind = b["id"].type
        key, ref, field, n = [], [], [], []
        for i, f, v in zip(b["id"].to_pylist(), b["field_name"].to_pylist(), b["value"].to_pylist()):
            words.update(tokens_of(v))
            h = xxhash.xxh64_intdigest(v)
            if h in seen:
                continue
            if len(seen) > 1_000_000:  # a repeated value is only counted out later
                seen.clear()
            seen.add(h)
            for k in twin_keys(v):
                key.append(xxhash.xxh64_hexdigest(k)), ref.append(i), field.append(f), n.append(h - (1 << 63))
        yield pa.record_batch([pa.array(["k"] * len(key), pa.string()), pa.array(key, pa.string()), pa.array(ref, kind), pa.array(field, pa.string()), pa.array(n, pa.int64())], _SURVEY)
        if len(words) > 500_000:
            yield flush()
    yield flush()


def character_map(garbled: str, clean: str) -> dict[str, str] | None:
    """Which character stands for which in aligned twins: a one-to-one map that changes nearly all of them, else None."""
    a, b = NON_ASCII.findall(garbled), NON_ASCII.findall(clean)
    if [len(x) for x in a] != [len(y) for y in b]:
        return None
    out: dict[str, str] = {}
    for x, y in zip("".join(a), "".join(b)):
        if out.setdefault(x, y) != y:
            return None
    changed = sum(x != y for x, y in out.items())
    return out if len(set(out.values())) == len(out) and changed >= LEAST_MAP and changed >= 0.8 * len(out) else None


def _explain(batches: Iterator[pa.RecordBatch], plausibility) -> Iterator[pa.RecordBatch]:
    """(written, read, garbled, clean, n): the characters that each fitting transformation explains; written is empty where no encodings fit."""
    for b in batches:
        seen: Counter = Counter()
        for a, c in zip(b["a"].to_pylist(), b["b"].to_pylist()):
            fits = [(w, r, x, y) for x, y in ((a, c), (c, a)) for w, r in transformations(x, y)]
            for w, r, x, y in fits:
                for ch in {*"".join(NON_ASCII.findall(y))}:
                    seen[w, r, "", ch] += 1
            if not fits:
                x, y = sorted((a, c), key=plausibility)
                if m := character_map(x, y):
                    seen.update(("", "", g, ch) for g, ch in m.items() if g != ch)
        yield pa.record_batch([*(pa.array([k[j] for k in seen], pa.string()) for j in range(4)), pa.array(seen.values(), pa.int64())], ["written", "read", "garbled", "clean", "n"])


def learn(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> tuple[dict[str, int], list[tuple[str, str]], dict[str, dict[str, str]]]:
    """Letter model, learned pairs of encodings, and the map of characters that no pair of encodings explains; from all values of all rows.

    Every distinct value of a twin group is aligned with the group's most plausible, and with the first and last
    in two orders, as texts of one skeleton may be several originals. Two encodings that are proven with others
    need less proof together. What reaches the driver is bounded by the symbols of the code pages: bigram counts,
    and one row for each explained character.
    """
    values = _fields(df, id_col, fields)
    kind = values.schema["id"].dataType.simpleString()
    survey = stored(spread(values).mapInArrow(_survey, f"kind string, key string, ref {kind}, field_name string, n bigint"), "encoding")
    counts = {r["key"]: r["n"] for r in survey.where("kind = 'g'").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    variants = survey.where("kind = 'k'").groupBy("key", "n").agg(F.min(F.struct("ref", "field_name")).alias("at"))
    several = survey.where("kind = 'k'").groupBy("key").agg(F.min("n").alias("x"), F.max("n").alias("y")).where("x <> y").select("key")
    twins = variants.join(several, "key").select("key", "n", "at.ref", "at.field_name")
    letters = Letters(counts)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("score", pa.array([letters.whole(v) for v in b["value"].to_pylist()], pa.float64()))

    rated = stored(twins.join(values.withColumnRenamed("id", "ref"), ["ref", "field_name"]).select("key", "n", "value").mapInArrow(rate, "key string, n bigint, value string, score double"), "twins")
    best = rated.groupBy("key").agg(F.max(F.struct("score", "value"))["value"].alias("best"), F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "n").alias("first"), F.max_by("value", "n").alias("last"))
    pairs = rated.join(best, "key").select(F.col("value").alias("a"), F.explode(F.array_distinct(F.array("best", "low", "high", "first", "last"))).alias("b")).where("a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    explained = pairs.mapInArrow(lambda batches: _explain(batches, letters.whole), "written string, read string, garbled string, clean string, n bigint")
    found = explained.groupBy("written", "read", "garbled", "clean").agg(F.sum("n").alias("n")).collect()
    proof: Counter = Counter()
    for r in found:
        if r["written"]:
            proof[r["written"], r["read"]] += r["n"]
    written, read = ({k[j] for k, n in proof.items() if n >= PROOF} for j in (0, 1))
    learned = sorted((k for k, n in proof.items() if n >= PROOF or (k[0] in written and k[1] in read)), key=lambda k: (-proof[k], k))
    return counts, learned, _own_map([(r["garbled"], r["clean"], r["n"]) for r in found if not r["written"]])


def _own_map(seen: list[tuple[str, str, int]], least: int = 2, share: float = 0.9) -> dict[str, dict[str, str]]:
    """The map of characters whose image several pairs agree on; none where too few of them are left."""
    total: Counter = Counter()
    for g, _, n in seen:
        total[g] += n
    m = {g: c for g, c, n in seen if n >= least and n >= share * total[g]}
    return {"own": m} if len(m) >= LEAST_MAP and len(set(m.values())) == len(m) else {}


def repair(df: DataFrame, id_col: str, fields: tuple[str, ...], margin: float = 2.0) -> DataFrame:
    """Garbled fields of ``df``: (id, field_name, garbled value, repaired, recovered)."""
    counts, learned, maps = learn(df, id_col, fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Repairer(counts, learned, maps, margin)
        for b in batches:
            got = [fix.value(v) for v in b["value"].to_pylist()]
            keep = pa.array([g[1] for g in got], pa.bool_())
            b = b.append_column("repaired", pa.array([g[0] for g in got], pa.string())).append_column("recovered", pa.array([g[2] for g in got], pa.bool_()))
            yield b.filter(keep)

    values = _fields(df, id_col, fields)
    kind = values.schema["id"].dataType.simpleString()
    return spread(values).mapInArrow(apply, f"id {kind}, field_name string, value string, repaired string, recovered boolean").withColumnRenamed("id", id_col)
