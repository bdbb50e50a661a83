"""Quantities stated in different units, converted to common units.

Method: a multi-pattern automaton finds unit aliases in the normalised text of every item; of the aliases
that start at one place the longest counts, it has to follow a number, and the item's own field names settle
what several quantities could mean. The found (unit, value) rows are then joined with the broadcast factors.

Edge cases (tests/test_units.py): null and empty arrays, items, keys and values give no row; a number without
a unit gives none; repeated rows each give their rows; the table may hold any other columns; an empty table
gives an empty result; long texts are scanned in one linear pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.runtime import col

# Units by quantity as (unit, factor, offset), so that common = value * factor + offset.
UNITS = {
    "temperature": (("degC", 1, 0), ("K", 1, -273.15), ("degF", 5 / 9, -160 / 9)),
    "pressure": (("kPa", 1, 0), ("Pa", 1e-3, 0), ("hPa", 0.1, 0), ("MPa", 1e3, 0), ("GPa", 1e6, 0), ("bar", 100, 0), ("mbar", 0.1, 0), ("atm", 101.325, 0), ("psi", 6.894757293168361, 0), ("ksi", 6894.757293168361, 0), ("mmHg", 0.133322387415, 0), ("kgf/cm2", 98.0665, 0)),
    "duration": (("min", 1, 0), ("ms", 1 / 6e4, 0), ("s", 1 / 60, 0), ("h", 60, 0), ("d", 1440, 0), ("week", 10080, 0)),
    "mass_concentration": (("g/L", 1, 0), ("kg/m3", 1, 0), ("mg/mL", 1, 0), ("mg/L", 1e-3, 0), ("g/m3", 1e-3, 0), ("ug/L", 1e-6, 0), ("mg/m3", 1e-6, 0), ("lb/ft3", 16.018463373960142, 0), ("lb/gal", 119.82642731689663, 0), ("oz/gal", 7.489151707306, 0)),
    "particle_size": (("um", 1, 0), ("nm", 1e-3, 0), ("mm", 1e3, 0), ("cm", 1e4, 0), ("inch", 25400, 0), ("mil", 25.4, 0)),
    "volume_flow": (("m3/h", 1, 0), ("m3/min", 60, 0), ("m3/s", 3600, 0), ("m3/d", 1 / 24, 0), ("L/h", 1e-3, 0), ("L/min", 0.06, 0), ("L/s", 3.6, 0), ("mL/min", 6e-5, 0), ("gal/min", 0.22712470704, 0), ("ft3/min", 1.69901082, 0)),
    "specific_energy": (("kWh/t", 1, 0), ("Wh/kg", 1, 0), ("kWh/kg", 1e3, 0), ("kWh/lb", 2204.6226218487757, 0), ("MWh/t", 1e3, 0), ("MJ/t", 1 / 3.6, 0), ("kJ/kg", 1 / 3.6, 0), ("GJ/t", 1e3 / 3.6, 0), ("MJ/kg", 1e3 / 3.6, 0)),
}
# Spellings of simple units, parts and whole names; composed ones follow by rule below.
SIMPLE = {
    "degC": ("°C", "° C", "°С", "° С", "deg C", "deg. C", "degC", "deg.C", "C", "С", "Celsius", "celsius", "degrees Celsius", "degrees C", "град. С", "град. C", "град.С", "град С", "градусов Цельсия", "Grad Celsius", "Grad C"),
    "K": ("K", "К", "°K", "Kelvin", "kelvin", "kelvins", "Kelvins", "кельвин", "Кельвин", "кельвинов"),
    "degF": ("°F", "° F", "deg F", "deg. F", "degF", "deg.F", "F", "Fahrenheit", "fahrenheit", "degrees Fahrenheit", "degrees F", "град. F", "Grad Fahrenheit"),
    "kPa": ("kPa", "KPa", "kpa", "кПа", "КПа", "kilopascal", "kilopascals", "килопаскаль", "Kilopascal"),
    "Pa": ("Pa", "Па", "pascal", "pascals", "Pascal", "паскаль"),
    "hPa": ("hPa", "гПа"),
    "MPa": ("MPa", "Mpa", "МПа", "megapascal", "megapascals", "мегапаскаль"),
    "GPa": ("GPa", "ГПа"),
    "bar": ("bar", "bars", "Bar", "бар", "bar(a)", "bara"),
    "mbar": ("mbar", "мбар", "millibar"),
    "atm": ("atm", "atm.", "атм", "атм.", "atmospheres", "атмосфер"),
    "psi": ("psi", "PSI", "psia", "lbf/in2", "lb/in2", "lbs/in2"),
    "ksi": ("ksi",),
    "mmHg": ("mmHg", "mm Hg", "mm. Hg", "мм рт. ст.", "мм рт.ст.", "мм рт ст", "мм рт. ст", "torr", "Torr"),
    "kgf/cm2": ("kgf/cm2", "кгс/см2", "kg/cm2", "кг/см2"),
    "mil": ("mil", "mils"),
}
PARTS = {
    "g": ("g", "г", "grams", "gram", "Gramm"), "mg": ("mg", "мг", "milligrams"), "ug": ("ug", "µg", "мкг", "mcg", "micrograms"), "kg": ("kg", "кг"),
    "L": ("L", "l", "л", "dm3", "дм3", "litre", "liter", "Liter"), "mL": ("mL", "ml", "мл", "cm3", "см3"),
    "m3": ("m3", "м3", "m^3", "м^3", "cubic metre", "cubic metres", "cubic meters", "куб. м", "cbm"),
    "lb": ("lb", "lbs", "lb.", "pound", "pounds", "фунт"), "ft3": ("ft3", "cubic foot", "cu ft", "cu. ft", "ft^3"), "oz": ("oz", "ounce"),
    "gal": ("gal", "US gal", "gallon", "US gallon", "gallons", "US gallons", "галлон"), "t": ("t", "т", "tonne", "ton", "tonnes", "Tonne", "тонну"),
    "h": ("h", "hr", "hrs", "hr.", "hrs.", "hour", "hours", "ч", "ч.", "час", "часа", "часов", "Std", "Std.", "Stunde", "Stunden"),
    "min": ("min", "min.", "mins", "minute", "minutes", "мин", "мин.", "минут", "минута", "минуты", "Minute", "Minuten"),
    "s": ("s", "s.", "sec", "sec.", "secs", "second", "seconds", "с", "с.", "сек", "сек.", "секунд", "Sek", "Sek.", "Sekunden"),
    "ms": ("ms", "мс"),
    "d": ("d", "d.", "day", "days", "сут", "сут.", "суток", "дней", "день", "дня", "Tag", "Tage"),
    "week": ("week", "weeks", "недель", "неделя", "Wochen"),
    "um": ("um", "µm", "micron", "microns", "мкм", "micrometre", "micrometres", "micrometer", "Mikrometer", "микрон"),
    "nm": ("nm", "нм", "nanometres", "nanometre"), "mm": ("mm", "мм", "millimetre", "millimetres"), "cm": ("cm", "см"),
    "inch": ("inch", "inches", "in.", "in", "дюйм", "дюйма", "дюймов", "Zoll"),
    "kWh": ("kWh", "kW·h", "kW h", "кВт·ч", "кВтч", "кВт ч", "kW*h", "kwh"), "Wh": ("Wh", "W·h", "Вт·ч"), "MWh": ("MWh", "МВт·ч", "MW·h"),
    "kJ": ("kJ", "кДж"), "MJ": ("MJ", "МДж"), "GJ": ("GJ", "ГДж"),
}
SHORT = {"gpl": "g/L", "gpm": "gal/min", "lpm": "L/min", "cfm": "ft3/min", "ppb (w/v)": "ug/L", "GPM": "gal/min", "LPM": "L/min"}
# Words of field names and running text that point to a quantity.
HINTS = {
    "temperature": ("temp", "температ", "roast", "обжиг"), "pressure": ("press", "давлен", "druck", "p(o2)", "autoclave"),
    "duration": ("time", "duration", "врем", "продолжит", "выдержк", "dauer", "stirred"), "mass_concentration": ("concentr", "концентр", "содержан", "h2so4", "liquor", "solution", "раствор", "konzentr"),
    "particle_size": ("size", "крупност", "korn", "d50", "p80", "grind", "ground"), "volume_flow": ("flow", "расход", "durchfluss", "feed"), "specific_energy": ("energ", "энерг", "power"),
}
WORDS = {w: n for n, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)} | {"twenty": 20, "thirty": 30, "forty": 40, "sixty": 60, "ninety": 90}
NAMED = ("name", "parameter", "value", "min", "max", "unit", "text")

_SUPER = str.maketrans({**dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")), "\xa0": " ", " ": " ", " ": " ", "μ": "µ", "−": "-", "∙": "·", "⋅": "·", "℃": "", "℉": ""})
_NUMBER = r"\d{1,3}(?:[ '’]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)*"
NUMBER = re.compile(rf"(?<![\w.,])[-+]?(?:{_NUMBER})(?:\s*(?:[·x×*]\s*10\s*\^?\s*(-?\d+)|[eE]([-+]?\d+)(?!\w)))?")
WORD_NUMBER = re.compile(rf"\b(?:{'|'.join(WORDS)})\b(?=\s)", re.I)
RANGE = re.compile(r"^\s*(?:…|\.\.\.?|–|—|-|to|bis|до|±|\+/-|and)\s*(?:[~≈<>]\s*)?$")
NOT_VALUE = re.compile(r"(?:stage|sample|step|стадия|проба|No\.?|№)\s*$|[A-Za-zА-Яа-я]-$", re.I)


def aliases() -> dict[str, tuple[str, ...]]:
    """Every spelling and the units it may stand for."""
    out: dict[str, set[str]] = {}
    named = {u for units in UNITS.values() for u, _, _ in units}
    for unit, names in {**SIMPLE, **{k: v for k, v in PARTS.items() if k in named}}.items():
        for x in names:
            out.setdefault(x, set()).add(unit)
    for unit in named:
        top, _, bottom = unit.partition("/")
        if bottom and top in PARTS and bottom in PARTS:
            for a, b in product(PARTS[top], PARTS[bottom]):
                for x in (f"{a}/{b}", f"{a} / {b}", f"{a} per {b}", f"{a} pro {b}", f"{a}·{b}-1", f"{a} {b}-1", f"{a}*{b}-1", f"{a} на {b}"):
                    out.setdefault(x, set()).add(unit)
    for x, unit in SHORT.items():
        out.setdefault(x, set()).add(unit)
    return {k: tuple(sorted(v)) for k, v in out.items()}


def factors(spark: SparkSession) -> DataFrame:
    rows = [(q, u, float(f), float(o)) for q, units in UNITS.items() for u, f, o in units]
    return spark.createDataFrame(rows, "quantity string, unit string, factor double, shift double")


def number(text: str) -> float | None:
    """A number as people write it: grouped thousands, decimal point or comma, powers of ten."""
    m = NUMBER.search(text)
    if not m:
        w = WORD_NUMBER.search(text + " ")
        return float(WORDS[w.group().lower()]) if w else None
    power = int(m.group(1) or m.group(2) or 0)
    x = re.match(rf"[-+]?(?:{_NUMBER})", m.group()).group().translate({32: None, 39: None, 0x2019: None})
    if "." in x and "," in x:
        x = x.replace("," if x.rfind(".") > x.rfind(",") else ".", "")
    elif x.count(",") > 1 or x.count(".") > 1:
        x = x.replace(",", "").replace(".", "")
    return float(x.replace(",", ".")) * 10.0**power


class Scanner:
    """Finds quantities in items; built once per task."""

    def __init__(self):
        self.names = aliases()
        self.of = {u: q for q, units in UNITS.items() for u, _, _ in units}
        self.auto = ahocorasick.Automaton()
        for x in self.names:
            self.auto.add_word(x, x)
        self.auto.make_automaton()

    @staticmethod
    def plain(text: str) -> str:
        return text.translate(_SUPER).replace("", "°C").replace("", "°F")

    def hint(self, text: str) -> str | None:
        """The quantity that a field name points to, if exactly one."""
        low = text.lower()
        got = [q for q, words in HINTS.items() if any(w in low for w in words)] or [q for q in HINTS if q.replace("_", " ") in low.replace("_", " ")]
        if text.strip() == "T":
            return "temperature"
        return got[0] if len(got) == 1 else None

    def sense(self, alias: str, context: str | None) -> str | None:
        units = self.names[alias]
        fit = [u for u in units if self.of[u] == context]
        if alias in ("in", "d.", "s.", "с.") and not fit and context:
            return None
        return (fit or list(units))[0]

    def unit(self, text: str | None, context: str | None) -> str | None:
        """The unit that a whole string names."""
        x = self.plain(text or "").strip()
        for y in (x, x.rstrip("."), re.sub(r"\s+", " ", x)):
            if y in self.names:
                return self.sense(y, context)
        return None

    def scan(self, text: str, context: str | None = None) -> list[tuple[str, float, float, float]]:
        """(unit, low, high, spread) of every number with a unit in running text."""
        text = self.plain(text)
        longest: dict[int, str] = {}
        for end, x in self.auto.iter(text):
            at = end - len(x) + 1
            after = text[end + 1 : end + 2]
            if (after.isalnum() or after in ("/", "^") or (after == "-" and text[end + 2 : end + 3].isdigit())) and not x.endswith("."):
                continue
            if len(x) > len(longest.get(at, "")):
                longest[at] = x
        spots = [(m.start(), m.end(), m.group()) for m in NUMBER.finditer(text)]
        spots += [(m.start(), m.end(), m.group()) for m in WORD_NUMBER.finditer(text)]
        spots.sort()
        out = []
        for i, (start, end, raw) in enumerate(spots):
            at = end + len(text[end:]) - len(text[end:].lstrip(" ")) if text[end : end + 1] == " " else end
            alias = longest.get(at)
            if alias is None or NOT_VALUE.search(text[:start]):
                continue
            unit = self.sense(alias, context)
            if unit is None:
                continue
            low = high = number(raw)
            spread = 0.0
            if i and (m := RANGE.match(text[spots[i - 1][1] : start])):
                first = number(spots[i - 1][2])
                if "±" in m.group() or "+/-" in m.group():
                    low, high, spread = first, first, high
                else:
                    low = first
            out.append((unit, low, high, spread))
        return out

    def _trailing(self, name: str, context: str | None) -> str | None:
        """A unit at the end of a field name: ``time, h``, ``time [h]``, ``time (h)``."""
        m = re.search(r"[\[(]([^\])]*)[\])]\s*$", name) or re.search(r",\s*([^,]+)$", name)
        return self.unit(m.group(1), context) if m else None

    def item(self, pairs: list[tuple[str, str | None]]) -> list[tuple[str, float, float, float]]:
        """Quantities of one free-form map."""
        got = {k: v for k, v in pairs if k is not None}
        out = []
        name = got.get("name") or got.get("parameter") or ""
        context = self.hint(name)
        if set(got) & {"value", "min", "max", "unit"}:
            values = [v for k in ("value", "min", "max") if (v := got.get(k))]
            unit = self.unit(got.get("unit"), context)
            found = [x for v in values for x in self.scan(v, context)]
            if unit is None and not found and not (got.get("unit") or "").strip():
                unit = self._trailing(name, context)
            if unit is not None and not found:
                numbers = [n for v in values if (n := number(self.plain(v))) is not None]
                if numbers and len(values) == 1 and (m := self.scan(f"{values[0]} {self._any(unit)}", context)):
                    out.append((unit, *m[-1][1:]))
                elif numbers:
                    out.append((unit, min(numbers), max(numbers), 0.0))
            out += found
        if got.get("text"):
            out += self.scan(got["text"], context)
        for k, v in got.items():
            if k not in NAMED and v:
                here = self.hint(k)
                found = self.scan(v, here)
                if not found and (unit := self._trailing(k, here)) and (n := number(self.plain(v))) is not None:
                    found = [(unit, n, n, 0.0)]
                out += found
        return out

    def _any(self, unit: str) -> str:
        return next(k for k, v in self.names.items() if v[0] == unit and not k.endswith("."))


def find_quantities(df: DataFrame, id_col: str, text_items: tuple[str, ...] = ("conditions",), map_items: tuple[str, ...] = ("process_parameters",)) -> DataFrame:
    """(id, field_name, item_pos, unit, low, high, spread) of every quantity in arrays of texts and of maps."""
    base = df.select(col(id_col).alias("id"), *(col(c).alias(f"f{i}") for i, c in enumerate((*text_items, *map_items))))
    fields = (*text_items, *map_items)
    kind = base.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner()
        for b in batches:
            rows = []
            ids = b["id"].to_pylist()
            for i, f in enumerate(fields):
                for key, items in zip(ids, b[f"f{i}"].to_pylist()):
                    for pos, x in enumerate(items or []):
                        if x:
                            rows += [(key, f, pos, *y) for y in (s.scan(x) if isinstance(x, str) else s.item(x))]
            types = [b["id"].type, pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], [id_col, "field_name", "item_pos", "unit", "low", "high", "spread"])

    return base.mapInArrow(scan, f"`{id_col}` {kind}, field_name string, item_pos int, unit string, low double, high double, spread double")


def to_common(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Found quantities in the common unit of ``targets`` (quantity, common_unit).

    The factor table has one row per unit in this module, so its broadcast is bounded by the code itself.
    A target unit other than the built-in common one is reached through it.
    """
    f = factors(found.sparkSession)
    goal = f.select("quantity", F.col("unit").alias("common_unit"), F.col("factor").alias("gf"), F.col("shift").alias("gs"))
    table = f.join(targets.select("quantity", "common_unit").distinct(), "quantity").join(goal, ["quantity", "common_unit"])
    x = found.join(F.broadcast(table), "unit")
    to = lambda c: (F.col(c) * F.col("factor") + F.col("shift") - F.col("gs")) / F.col("gf")
    same = (F.abs(F.col("factor") / F.col("gf") - 1) < 1e-12) & (F.abs(F.col("shift") - F.col("gs")) < 1e-12)
    return x.select(
        *found.columns, "quantity", "common_unit", to("low").alias("common_low"), to("high").alias("common_high"), (F.col("spread") * F.col("factor") / F.col("gf")).alias("common_spread"), (~same).alias("converted")
    )
