"""Plain Latin letters for names and titles in Latin and Cyrillic."""

from __future__ import annotations

import unicodedata

# Latin spelling of Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "і": "i", "ї": "i", "є": "ie", "ґ": "g", "ў": "u",
}
_TABLE = str.maketrans({k: v for k, v in CYRILLIC.items()} | {k.upper(): v.capitalize() for k, v in CYRILLIC.items()} | {"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe"})


def latin(text: str) -> str:
    """The text in Latin letters without marks."""
    x = unicodedata.normalize("NFKC", text).translate(_TABLE)
    return "".join(ch for ch in unicodedata.normalize("NFD", x) if not unicodedata.combining(ch))
