"""Noise in text from scanned pages: words broken across lines, misread characters, running headers, page numbers.

Method: a frequency lexicon and bigram counts are taken over the whole corpus. A symmetric-delete index over
the lexicon yields candidates for every rare word; a weighted edit distance in which only known confusions of
scanners are cheap keeps the plausible ones, and bigram context of each place picks the repair. Broken words
are joined where the lexicon knows the joined form better than the parts; page numbers and running lines are
taken out where they interrupt the text.

Edge cases (tests/llm/test_scanned.py): null and empty texts give no row; very long texts and words are handled
in linear time, words over MAX_WORD characters are no misread words; repeated rows each get their row; an empty
table gives an empty result; only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.runtime import col, spread, stored

# What a scanner may read (right) for what was printed (left).
CONFUSIONS = (
    ("e", "c"), ("o", "0"), ("O", "0"), ("t", "+"), ("n", "ri"), ("i", "l"), ("l", "1"), ("I", "1"), ("l", "i"), ("d", "cl"), ("u", "ii"), ("h", "b"), ("m", "rn"), ("g", "9"), ("w", "vv"), ("f", "t"), ("F", "t"),
    ("s", "5"), ("S", "5"), ("B", "8"), ("b", "6"), ("z", "2"), ("Z", "2"), ("M", "rn"), ("D", "cl"), ("H", "b"), ("E", "c"),
    ("о", "0"), ("О", "0"), ("е", "с"), ("т", "г"), ("и", "н"), ("л", "п"), ("в", "b"), ("п", "н"), ("м", "rn"), ("з", "3"), ("З", "3"), ("ы", "ьi"), ("ю", "io"), ("б", "6"), ("ш", "щ"), ("ц", "п"),
    ("В", "b"), ("М", "rn"), ("П", "н"), ("Т", "г"), ("Л", "п"), ("Е", "с"), ("И", "н"), ("й", "н"), ("ч", "4"),
)
CHEAP = 0.3
MAX_WORD = 32
MAX_COMMON = 50_000  # size of the word set that spares every task the frequent words; it decides nothing, all other words take the join
LINES = 3  # distinct texts in which a line has to stand between the halves of a sentence to be a running one
PREFIX = 7  # deletes are taken from this prefix, as in the symmetric-delete method
RATIO = 20  # a candidate has to be at least so many times as frequent as the word

WORD = re.compile(r"[^\W_]+(?:\+[^\W\d_]+)*\+?")
BREAK = re.compile(r"([^\W\d_]+)([-‐¬\xad])[ \t]*\n[ \t]*([^\W\d_]+)")
PAGE_LINE = re.compile(
    r"[ \t]*(?:[-–—][ \t]*\d{1,4}[ \t]*[-–—]|\[\d{1,4}\]|\d{1,4}"
    r"|(?:[Pp]age|[Pp]\.|[Pp]g\.|[Сс]тр\.|[Сс]траница|[Сс]\.|S\.|[Ss]eite|[Pp]ág\.)[ \t]*\d{1,4}(?:[ \t]*(?:of|из|von|de|sur|/)[ \t]*\d{1,4})?)[ \t]*"
)
NUMBERED_EDGE = re.compile(r"[ \t]*(?:\d{1,4}[ \t]{2,}[^\W\d_].*|.*[^\W\d_][^ \t]*[ \t]{2,}\d{1,4})[ \t]*")
ISSUE_LINE = re.compile(r".*[^\W\d_], (?:19|20)\d\d, (?:No|№|Nr|n°|núm)\.? ?\d+[ \t]*")
BAD_NUMBER = re.compile(r"(?<![\w.,?+-])(?=[^\s]*\d)(?=\d*[.,]?\d*[OolISBZбОЗ])[\dOolISBZбОЗ]{1,6}[.,][\dOolISBZбОЗ]{1,6}(?![\w,]|\.\w)")
PLAIN_NUMBER = re.compile(r"\s*[-+]?\d+(?:[.,]\d+)?\s*")
SENTENCE_END = re.compile(r"[.!?:;…»”\"')\]][ \t]*$")
TO_DIGIT = str.maketrans({"O": "0", "o": "0", "О": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2", "б": "6", "З": "3"})
MIXED_NUMBER = re.compile(r"\d[.,]?[OolISBZбОЗ]|[OolISBZбОЗ][.,]?\d")
BROKEN = re.compile(r"[^\W\d_][-‐¬\xad][ \t]*\n")
MOVED = re.compile(r" ([.,;:])(?=[^\W\d_])")  # a mark that went over to the next word
OPEN_BREAK = r"\p{L}-[ \t]*\n[ \t]*\p{Ll}"  # a hyphen at a line end that may belong to a compound
OPEN_LINE = r"\S[ \t]*\n[ \t]*\p{Lu}[^\n]{2,88}[\p{L}\p{N}][ \t]*\n[ \t]*\p{Ll}"  # a line that may be a running one inside a sentence
DIGIT_INSIDE = r"\p{L}[0-9]+\p{L}|^[0-9]\p{L}{3,}|\p{L}{3,}[0-9]$"
BLANK = re.compile(r"[ \t]*\n[ \t]*\n\s*")
ITEM = re.compile(r"\s*(?:[-•·–—*]\s|\d{1,3}[.)]\s|[a-zа-я]\)\s)|\s*[-+]?\d+(?:[.,]\d+)?\s*$|.*\s\|\s|---")
SEPARATOR = re.compile(r"\s*[|;\t]\s*| {2,}")


def joined(text: str) -> str:
    """The text with all words that a line end breaks put together."""
    return BREAK.sub(r"\1\3", text) if BROKEN.search(text) else text


def deletes(word: str, depth: int = 2) -> set[str]:
    """The word's prefix with up to ``depth`` characters taken out."""
    level = {word[:PREFIX]}
    out = set(level)
    for _ in range(depth):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def _classes() -> tuple[dict[str, str], dict[str, str]]:
    """Letters that confusions connect, each with the first of its class; and pairs of letters read for one."""
    head: dict[str, str] = {}

    def find(x: str) -> str:
        while head.get(x, x) != x:
            x = head[x]
        return x

    first: dict[str, str] = {}
    for printed, read in CONFUSIONS:
        other = read if len(read) == 1 else first.setdefault(read, printed)
        a, b = sorted((find(printed), find(other)))
        head[b] = a
        head.setdefault(a, a)
    return {x: find(x) for x in head}, {read: find(printed) for read, printed in first.items()}


_ONE, _TWO = _classes()
_TWO_LETTERS = re.compile("|".join(sorted({"".join(p) for k in _TWO for p in product(*([x for x in _ONE if _ONE[x] == _ONE.get(ch, ch)] or [ch] for ch in k))})))
_CLASS = str.maketrans(_ONE)


def canonical(word: str) -> str:
    """What all words that confusions alone tell apart have in common."""
    classes = {"".join(_ONE.get(ch, ch) for ch in k): v for k, v in _TWO.items()}
    x = _TWO_LETTERS.sub(lambda m: classes[m.group().translate(_CLASS)], word)
    return x.translate(_CLASS)


_TO: dict[str, list[str]] = {}
for _printed, _read in CONFUSIONS:
    _TO.setdefault(_read, []).append(_printed)


def misread_cost(read: str, printed: str, most: float = 1.0) -> float:
    """Weighted edit distance from what was read to what was printed; a plain edit costs 1, a confusion CHEAP."""
    n, m = len(read), len(printed)
    if abs(n - m) > 4:
        return math.inf
    row: list[list[float]] = [[math.inf] * (m + 1) for _ in range(n + 1)]
    row[0][0] = 0
    for i in range(n + 1):
        here = row[i]
        for j in range(max(0, i - 5), min(m, i + 5) + 1):
            d = here[j]
            if d > most:
                continue
            if i < n and j < m and read[i] == printed[j]:
                row[i + 1][j + 1] = min(row[i + 1][j + 1], d)
            for width in (1, 2):
                for p in _TO.get(read[i : i + width], ()) if i + width <= n else ():
                    if printed.startswith(p, j):
                        row[i + width][j + len(p)] = min(row[i + width][j + len(p)], d + CHEAP)
            if i < n and j < m:
                row[i + 1][j + 1] = min(row[i + 1][j + 1], d + 1)
            if i < n:
                row[i + 1][j] = min(row[i + 1][j], d + 1)
            if j < m:
                here[j + 1] = min(here[j + 1], d + 1)
    return row[n][m]


def running_lines(text: str, table: bool = False) -> list[int]:
    """Numbers of the lines that are page numbers or running headers and footers."""
    if "\n" not in text:
        return []
    lines = text.split("\n")
    out: set[int] = set()
    for i, x in enumerate(lines):
        if len(x) > 30 or not x or not PAGE_LINE.fullmatch(x):
            continue
        if x.strip().isdigit():
            if any(PLAIN_NUMBER.fullmatch(lines[k]) for k in (i - 1, i + 1) if 0 <= k < len(lines)):
                continue  # part of a column of numbers
            if i and lines[i - 1].rstrip().endswith(":"):
                continue  # the value of a list item whose line was wrapped
        out.add(i)
    cells = 0
    for i, x in enumerate(lines):
        if i in out or not x:
            continue
        if "  " in x and (x[0].isdigit() or x.rstrip()[-1:].isdigit()) and NUMBERED_EDGE.fullmatch(x) and len(SEPARATOR.split(x.strip())) == 2:
            if table and not cells:
                cells = Counter(len(SEPARATOR.split(y)) for y in lines if y.strip()).most_common(1)[0][0]
            if not table or cells != 2:
                out.add(i)
        elif not table and x[-1].isdigit() and ISSUE_LINE.fullmatch(x):
            out.add(i)
        elif not table and 0 < i < len(lines) - 1 and x.isupper() and len(x) >= 8 and sum(map(str.isalpha, x)) >= 8:
            before, after = lines[i - 1].rstrip(), lines[i + 1].lstrip()
            if before and after and not before.isupper() and not after.isupper() and not SENTENCE_END.search(before):
                out.add(i)
    return sorted(out | _beside(lines, out, table)) if out else []


def _beside(lines: list[str], running: set[int], table: bool) -> set[int]:
    """Headers that stand beside a page number and nowhere in a sentence: a title between two halves of one, or at the text's edge."""
    more: set[int] = set()
    for i in running:
        for j in (i - 1, i + 1):
            if j in running or not 0 <= j < len(lines):
                continue
            x = lines[j].strip()
            if not x or len(x) > 90 or ITEM.match(lines[j]) or not x[0].isupper() or SENTENCE_END.search(x) or not x[-1].isalnum():
                continue
            if table:
                if len(SEPARATOR.split(x)) == 1:
                    more.add(j)
                continue
            low, high = min(i, j) - 1, max(i, j) + 1
            while low in running:
                low -= 1
            while high in running:
                high += 1
            before = lines[low].strip() if low >= 0 else ""
            after = lines[high].strip() if high < len(lines) else ""
            width = max((len(lines[k]) for k in range(max(0, low - 4), min(len(lines), high + 5)) if k != j and k not in running and not lines[k].isupper()), default=0)
            if ". " in x or len(x) + 1 + len((after.split() or [""])[0]) > width - 2:
                continue  # a line of the text that is as full as the others
            halves = bool(before and after) and not SENTENCE_END.search(before) and (after[0].islower() or before.endswith(("-", "‐", "¬", "\xad")))
            if halves or (high >= len(lines) and (not before or SENTENCE_END.search(before))):
                more.add(j)
    return more


def broken_words(text: str, kept: set[str]) -> list[re.Match]:
    """Places where a word is broken across two lines; the compounds in ``kept`` keep their hyphen and are none."""
    if not BROKEN.search(text):
        return []
    out = []
    for m in BREAK.finditer(text):
        a, mark, b = m.groups()
        if mark != "-" or (b[0].islower() and f"{a}-{b}" not in kept):
            out.append(m)
    return out


def open_lines(text: str) -> Iterator[tuple[int, str]]:
    """Lines between two halves of a sentence that end although the next word would have found room."""
    lines = text.split("\n")
    for i in range(1, len(lines) - 1):
        x = lines[i].strip()
        if not 4 <= len(x) <= 90 or not x[0].isupper() or not x[-1].isalnum() or x.isupper() or ". " in x or ITEM.match(lines[i]):
            continue
        before, after = lines[i - 1].strip(), lines[i + 1].strip()
        if not before or not after or not after[0].islower() or SENTENCE_END.search(before):
            continue
        width = max((len(lines[k]) for k in range(max(0, i - 4), min(len(lines), i + 5)) if k != i), default=0)
        if len(x) + 1 + len(after.split()[0]) <= width - 2:
            yield i, x


class Page:
    """What scanning did to one text: running lines, broken words, misread numbers; ``clean`` is without them."""

    __slots__ = ("breaks", "clean", "numbers", "running")

    def __init__(self, text: str, marks: set[str], table: bool):
        """``marks`` are the settled doubts of this text: compounds with their hyphen, running lines after a line break."""
        self.running = running_lines(text, table)
        if marks and not table:
            self.running = sorted({*self.running, *(i for i, x in open_lines(text) if "\n" + x in marks)})
        if self.running:
            drop = set(self.running)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
        spots = broken_words(text, marks)
        self.breaks = len(spots)
        for m in reversed(spots):
            text = text[: m.start()] + m.group(1) + m.group(3) + text[m.end() :]
        self.numbers = 0
        if MIXED_NUMBER.search(text):
            text, self.numbers = BAD_NUMBER.subn(lambda m: m.group().translate(TO_DIGIT), text)
        self.clean = text


def paragraphs(text: str) -> str:
    """Lines of a paragraph joined, marks put back to their words; headings, list items and columns of numbers keep their lines."""
    out = []
    for block in BLANK.split(MOVED.sub(r"\1 ", text)):
        lines: list[str] = []
        for x in block.split("\n"):
            x = x.strip()
            if x and lines and not ITEM.match(x) and not lines[-1].isupper() and not PLAIN_NUMBER.fullmatch(lines[-1]) and not lines[-1].startswith("---"):
                lines[-1] += " " + x
            elif x:
                lines.append(x)
        if lines:
            out.append("\n".join(lines))
    return "\n\n".join(out)


def _inputs(tables: dict[str, tuple[DataFrame, str, str]], as_table: set[str]) -> DataFrame:
    """(table_name, record_id, tabular, text) of all tables; each is (frame, id column, text column)."""
    parts = [
        df.select(F.lit(name).alias("table_name"), col(i).cast("string").alias("record_id"), F.lit(name in as_table).alias("tabular"), col(t).alias("text")).where("text <> ''")
        for name, (df, i, t) in tables.items()
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return spread(out)


def _gram(a: str, b: str) -> int:
    return xxhash.xxh64_intdigest(f"{a} {b}") - (1 << 63)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (word, n) and hashed bigrams (gram, n) of the partition. Counting goes by raw tokens, which are few."""
    tokens: Counter = Counter()
    grams: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        parts = {t: WORD.findall(t) for t in tokens}
        words: Counter = Counter()
        two: Counter = Counter()
        for t, n in tokens.items():
            for w in parts[t]:
                words[w] += n
            for a, b in pairwise(parts[t]):
                two[_gram(a, b)] += n
        for (x, y), n in grams.items():
            if (a := parts[x]) and (b := parts[y]):
                two[_gram(a[-1], b[0])] += n
        m, k = len(words), len(two)
        yield pa.record_batch([pa.array(words, pa.string()), pa.nulls(m, pa.int64()), pa.array(words.values(), pa.int64())], ["word", "gram", "n"])
        yield pa.record_batch([pa.nulls(k, pa.string()), pa.array(two, pa.int64()), pa.array(two.values(), pa.int64())], ["word", "gram", "n"])
        tokens.clear(), grams.clear()

    for b in batches:
        for text in b["text"].to_pylist():
            t = joined(text).split()
            tokens.update(t)
            grams.update(pairwise(t))
        if len(grams) > 1_000_000:
            yield from flush()
    yield from flush()


def _delete_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        word, n, key = [], [], []
        for w, k in zip(b["word"].to_pylist(), b["n"].to_pylist()):
            for x in (*deletes(w), "=" + canonical(w)):
                word.append(w), n.append(k), key.append(x)
        yield pa.record_batch([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(key, pa.string())], ["word", "n", "key"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(w, c, n, d) for w, c, n in zip(b["word"].to_pylist(), b["candidate"].to_pylist(), b["candidate_n"].to_pylist()) if (d := misread_cost(w, c)) < 1]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.float64()))], ["word", "candidate", "candidate_n", "cost"])


def candidates(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, candidate, candidate_n, cost): what each rare word may have been, from the symmetric-delete index.

    Both sides of the join are distinct words, not occurrences. A key is a prefix of at most PREFIX characters
    with two left out, or the whole word by classes of confused letters, which any number of confusions leaves
    alone; with it goes a band of lengths. A word on the index side is ``ratio`` times as frequent; for a digit
    among letters it is enough that a word without one is as frequent.
    """
    sized = words.where(F.length("word").between(3, MAX_WORD) & F.col("word").rlike(r"\p{L}"))
    keys = sized.mapInArrow(_delete_keys, "word string, n bigint, key string")
    band = lambda shift: F.floor((F.length("word") + shift) / 5)
    index = keys.where("n >= 5").select("key", band(0).alias("band"), F.col("word").alias("candidate"), F.col("n").alias("candidate_n"))
    digit = F.col("word").rlike(DIGIT_INSIDE)
    rare = keys.where(F.length("word") >= 4).select("key", "word", "n", digit.alias("digit"), F.explode(F.array_distinct(F.array(band(-2), band(2)))).alias("band"))
    more = F.col("candidate_n") >= F.when(F.col("digit") & ~F.col("candidate").rlike("[0-9]"), F.col("n")).otherwise(ratio * F.greatest("n", F.lit(1)))
    near = rare.join(index, ["key", "band"]).where(more & (F.abs(F.length("word") - F.length("candidate")) <= 2) & (F.col("word") != F.col("candidate")))
    return near.select("word", "candidate", "candidate_n").distinct().mapInArrow(_verify, "word string, candidate string, candidate_n bigint, cost double")


def _doubts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(table_name, record_id, h, mark, left, right) of the compounds and lines that only the corpus can settle; h is the text's hash."""
    for b in batches:
        rows = []
        for name, key, tab, text in zip(*(b[c].to_pylist() for c in ("table_name", "record_id", "tabular", "text"))):
            h = xxhash.xxh64_intdigest(text) - (1 << 63)
            rows += {(name, key, h, f"{m[1]}-{m[3]}", m[1], m[3]) for m in BREAK.finditer(text) if m[2] == "-" and m[3][0].islower()}
            if not tab:
                rows += {(name, key, h, "\n" + x, None, None) for _, x in open_lines(text)}
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(_DOUBT.types)], schema=_DOUBT)


_DOUBT = pa.schema([("table_name", pa.string()), ("record_id", pa.string()), ("h", pa.int64()), ("mark", pa.string()), ("left", pa.string()), ("right", pa.string())])


def settled(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(table_name, record_id, marks): compounds that keep their hyphen and lines that are running ones, settled by joins with the whole lexicon.

    A compound keeps its hyphen where both parts are words and the joined form is none; a line is a running one
    where LINES distinct texts have it between the halves of a sentence.
    """
    doubts = stored(texts.mapInArrow(_doubts, "table_name string, record_id string, h bigint, mark string, left string, right string"), "doubts")
    pairs = doubts.where("left is not null").select("mark", "left", "right").distinct()
    w = words.select("word")
    kept = (
        pairs.join(w.withColumnRenamed("word", "left"), "left", "left_semi").join(w.withColumnRenamed("word", "right"), "right", "left_semi")
        .withColumn("word", F.concat("left", "right")).join(w, "word", "left_anti").select("mark")
    )
    lines = doubts.where("left is null").groupBy("mark", "h").agg(F.lit(1).alias("one")).groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") >= LINES).select("mark")
    return doubts.select("table_name", "record_id", "mark").distinct().join(kept.unionByName(lines), "mark").groupBy("table_name", "record_id").agg(F.collect_set("mark").alias("marks"))


def repair(tables: dict[str, tuple[DataFrame, str, str]], as_table: set[str] = frozenset(), ratio: int = RATIO) -> DataFrame:
    """Damaged records: (table_name, record_id, breaks, running_lines, numbers, words, text, repaired).

    Two passes over the texts: counts, over distinct texts so that copies have no more say than one, then
    inspection. Of the second only records with any trace go on, with their unknown words, to the joins with
    candidates and bigram counts. Texts with doubtful compounds or lines, and only those, are joined with their verdicts.
    """
    texts = _inputs(tables, set(as_table))
    counts = stored(texts.select("text").distinct().mapInArrow(_count, "word string, gram bigint, n bigint"), "counts")
    words = stored(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    grams = counts.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("gram_n"))
    may_be = stored(candidates(words, ratio), "candidates")
    plain = stored(words.where(F.col("n") >= 5).join(may_be.select("word").distinct(), "word", "left_anti"), "plain")
    known = frozenset(r["word"] for r in plain.orderBy(F.desc("n"), "word").limit(MAX_COMMON).select("word").collect())
    doubtful = F.col("text").rlike(OPEN_BREAK) | (~F.col("tabular") & F.col("text").rlike(OPEN_LINE))
    some = texts.where(doubtful)
    plain_texts = texts.where(~doubtful).withColumn("marks", F.lit(None).cast("array<string>"))
    every = some.join(settled(some, plain), ["table_name", "record_id"], "left").unionByName(plain_texts)

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fine: set[str] = set()  # raw tokens made of known words only
        for b in batches:
            rows = []
            for name, key, tab, text, marks in zip(*(b[c].to_pylist() for c in ("table_name", "record_id", "tabular", "text", "marks"))):
                page = Page(text, {*marks} if marks else set(), tab)
                odd = False
                for t in set(page.clean.split()).difference(fine):
                    if all(w in known or len(w) < 4 or len(w) > MAX_WORD for w in WORD.findall(t)):
                        if len(fine) < 200_000:
                            fine.add(t)
                    else:
                        odd = True
                        break
                found = []
                if odd:
                    w = WORD.findall(page.clean)
                    found = [{"pos": i, "word": x, "before": _gram_or_none(w, i - 1), "after": _gram_or_none(w, i + 1)} for i, x in enumerate(w) if x not in known and 4 <= len(x) <= MAX_WORD]
                if found or page.running or page.breaks or page.numbers:
                    rows.append((name, key, tab, page.breaks, len(page.running), page.numbers, text, page.clean, found))
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(_INSPECTED.types)], schema=_INSPECTED)

    seen = stored(every.mapInArrow(inspect, _INSPECTED_DDL), "inspected")
    spots = seen.select("table_name", "record_id", F.explode("odd").alias("o")).select("table_name", "record_id", "o.*").join(may_be, "word")
    side = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws(" ", a, b))
    wanted = stored(spots.withColumns({"left": side("before", "candidate"), "right": side("candidate", "after")}), "spots")
    context = wanted.select(F.explode(F.array("left", "right")).alias("pair")).where("pair is not null").distinct()
    context = context.mapInArrow(_gram_keys, "pair string, gram bigint").join(grams, "gram").select("pair", "gram_n")
    scored = (
        wanted.join(context.select(F.col("pair").alias("left"), F.col("gram_n").alias("left_n")), "left", "left")
        .join(context.select(F.col("pair").alias("right"), F.col("gram_n").alias("right_n")), "right", "left")
        .withColumn("score", F.log("candidate_n") / 4 + F.log1p(F.coalesce("left_n", F.lit(0))) + F.log1p(F.coalesce("right_n", F.lit(0))) - 4 * F.col("cost"))
    )
    best = scored.groupBy("table_name", "record_id", "pos").agg(F.max_by(F.struct("word", "candidate"), F.struct("score", "candidate")).alias("x"))
    fixes = best.groupBy("table_name", "record_id").agg(F.collect_list(F.struct("pos", F.col("x.candidate").alias("word"))).alias("fixes"))
    hit = seen.drop("odd").join(fixes, ["table_name", "record_id"], "left").where("fixes is not null or breaks + running_lines + numbers > 0")
    return hit.mapInArrow(_write, "table_name string, record_id string, breaks int, running_lines int, numbers int, words int, text string, repaired string")


_INSPECTED_DDL = "table_name string, record_id string, tabular boolean, breaks int, running_lines int, numbers int, text string, clean string, odd array<struct<pos:int,word:string,before:string,after:string>>"
_INSPECTED = pa.schema(
    [("table_name", pa.string()), ("record_id", pa.string()), ("tabular", pa.bool_()), ("breaks", pa.int32()), ("running_lines", pa.int32()), ("numbers", pa.int32()), ("text", pa.string()), ("clean", pa.string())]
    + [("odd", pa.list_(pa.struct([("pos", pa.int32()), ("word", pa.string()), ("before", pa.string()), ("after", pa.string())])))]
)


def _gram_or_none(words: list[str], i: int) -> str | None:
    return words[i] if 0 <= i < len(words) else None


def _gram_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b["pair"], pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in b["pair"].to_pylist()], pa.int64())], ["pair", "gram"])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the chosen words into the text and lay it out again."""
    for b in batches:
        done, n = [], []
        for text, tab, fixes in zip(b["clean"].to_pylist(), b["tabular"].to_pylist(), b["fixes"].to_pylist()):
            new = {f["pos"]: f["word"] for f in fixes or ()}
            n.append(len(new))
            if new:
                parts, at = [], 0
                for i, m in enumerate(WORD.finditer(text)):
                    if i in new:
                        parts += [text[at : m.start()], new[i]]
                        at = m.end()
                text = "".join([*parts, text[at:]])
            done.append(text if tab else paragraphs(text))
        keep = [b[c] for c in ("table_name", "record_id", "breaks", "running_lines", "numbers")]
        yield pa.record_batch([*keep, pa.array(n, pa.int32()), b["text"], pa.array(done, pa.string())], ["table_name", "record_id", "breaks", "running_lines", "numbers", "words", "text", "repaired"])
