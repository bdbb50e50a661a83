"""Text expressions: Column to Column, all in the JVM.

Null and empty input gives null or empty output; nothing here raises on any text. Patterns avoid look-around,
so that they mean the same in other engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_.+#%-]+"
WORD = r"[\p{L}\p{N}]+"
EDGE = r"^[.+#%_-]+|[.+#%_-]+$"
YEAR = r"(19[5-9][0-9]|20[0-2][0-9]|203[0-5])"
DOI = r"10\.[0-9]{4,9}/[^\s\"<>]+"
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"  # of a text in lower case
NUMBER_UNIT = r"[0-9]+(?:[.,][0-9]+)? ?(?:%|°C|mg/L|mm|m3/h|kt|Mt|h|s)"


def is_empty(x: Column, kind: str) -> Column:
    """Null, '' or an empty array or map; 0 and false are not empty."""
    if kind == "string":
        return F.coalesce(x == "", F.lit(True))
    return F.coalesce(F.size(x) <= 0, F.lit(True))


def collapse(x: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", "")


def normalise(x: Column) -> Column:
    """Lower case without the letters that case folding changes; ё as е."""
    return F.replace(F.replace(F.lower(collapse(x)), F.lit("ß"), F.lit("ss")), F.lit("ё"), F.lit("е"))


def compact(x: Column, most: int) -> Column:
    """Collapsed text, cut to ``most`` characters with an ellipsis."""
    c = collapse(x)
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 3), r"\s+$", ""), F.lit("..."))).otherwise(c)


def snippet(x: Column, most: int) -> Column:
    """Text cut to ``most`` characters with an ellipsis, white space kept; 0 for no limit."""
    if most <= 0:
        return x
    return F.when(F.length(x) > most, F.concat(F.regexp_replace(F.substring(x, 1, most - 3), r"\s+$", ""), F.lit("..."))).otherwise(x)


def last_index(x: Column, mark: str) -> Column:
    """1-based place of the last ``mark``; 0 for none."""
    at = F.instr(F.reverse(x), mark[::-1])
    return F.when(at > 0, F.length(x) - at - len(mark) + 2).otherwise(0)


def prepared(x: Column, most: int, terms: int) -> Column:
    """First ``terms`` words, cut at the right-most end of a sentence, clause or word before ``most`` unless that is below the half."""
    words = F.array_join(F.slice(F.split(collapse(x), " "), 1, terms), " ")
    head = F.substring(words, 1, most)
    at = F.greatest(last_index(head, ". "), last_index(head, "; "), last_index(head, " "))
    return F.when(F.length(words) <= most, words).when(at > most // 2, F.substring(head, F.lit(1), at)).otherwise(head)


def tokens(x: Column, least: int = 2) -> Column:
    """Search tokens: letters, digits and inner marks, at least ``least`` characters, in order."""
    raw = F.transform(F.regexp_extract_all(normalise(x), F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(t, EDGE, ""))
    return F.filter(raw, lambda t: F.length(t) >= least)


def distinct_tokens(x: Column, most: int | None = None, least: int = 2) -> Column:
    out = F.array_distinct(tokens(x, least))
    return F.slice(out, 1, most) if most else out


def words(x: Column) -> Column:
    return F.regexp_extract_all(normalise(x), F.lit(WORD), F.lit(0))


def ngrams(a: Column, n: int) -> Column:
    """Runs of ``n`` array items joined by spaces."""
    return F.when(
        F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - (n - 1)), lambda i: F.array_join(F.slice(a, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))


def occurrences(x: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(term), F.lit("")))) / len(term)).cast("bigint")


def once(x: Column, fn) -> Column:
    """``fn`` of an expression that is evaluated only once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(x), fn), 1)


def term_counts(toks: Column, terms: list[str]) -> Column:
    """Struct of the number of tokens (n) and of each term's occurrences (t0, t1, ...), in one walk over the tokens."""
    zero = F.struct(F.lit(0).alias("n"), *(F.lit(0).alias(f"t{i}") for i in range(len(terms))))
    step = lambda a, x: F.struct((a["n"] + 1).alias("n"), *((a[f"t{i}"] + (x == t).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)))
    return F.aggregate(toks, zero, step)


def coverage(x: Column, terms: list[str]) -> Column:
    """Share of the distinct terms that the text contains."""
    hits = sum((x.contains(t).cast("int") for t in terms), F.lit(0))
    return hits / F.lit(float(max(1, len(terms))))


def has_term(x: Column, term: str) -> Column:
    """Whether a term occurs; terms of one or two ASCII characters only as whole words."""
    if len(term) <= 2 and term.isascii():
        return x.rlike(rf"(^|[^\p{{L}}\p{{N}}]){term}([^\p{{L}}\p{{N}}]|$)")
    return x.contains(term)


def alias_match(text: Column, toks: Column, alias: str) -> Column:
    """Short ASCII aliases as whole tokens, phrases as substrings, others as tokens or their beginnings."""
    if len(alias) <= 3 and alias.isascii():
        return F.array_contains(toks, alias)
    if " " in alias or "-" in alias:
        return text.contains(alias)
    return F.exists(toks, lambda t: t.startswith(alias))


def script_language(x: Column, window: int | None = None, ratio: float = 0.2) -> Column:
    """ru, en, mixed or unknown by the letters of the whole text, or of its first ``window`` characters."""
    head = F.lower(F.substring(x, 1, window) if window else x)
    counts = F.struct(F.length(F.regexp_replace(head, "[^а-яё]", "")).alias("ru"), F.length(F.regexp_replace(head, "[^a-z]", "")).alias("en"))

    def verdict(c: Column) -> Column:
        ru, en, top = c["ru"], c["en"], F.greatest(c["ru"], c["en"])
        return F.when((top == 0) | top.isNull(), "unknown").when(F.least(ru, en) / top > ratio, "mixed").when(ru > en, "ru").otherwise("en")

    return once(counts, verdict)


def matches(x: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)))


def hash_like(x: Column) -> Column:
    """Titles that are only a hash or a number."""
    return F.coalesce(F.lower(F.trim(x)).rlike(r"^([0-9a-f]{12,}|[0-9]+|no [0-9]+)$"), F.lit(False))


def extend_unique(parts: list[Column], most: int) -> Column:
    """Arrays one after the other, each value once, at most ``most``."""
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])), 1, most)


def micro(x: Column) -> Column:
    """A score in millionths as a whole number, so that equal scores compare equal in any engine."""
    return F.floor(x.cast("double") * 1e6 + 0.5).cast("bigint")
