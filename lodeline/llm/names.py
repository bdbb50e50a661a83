"""Variant spellings of people's and organisations' names, linked to entities.

Method: pigeonhole segment join. Names are cut into k + 1 segments, one of which any name within k edits must
share at a shifted place; an inverted index of segments proposes pairs and a banded edit distance verifies
them. The join runs three times, each on distinct spellings: over the places in organisation names, over the
surnames within one place, and between people without a place and all others with the same initial. Spellings
then go to the most frequent spelling near them, and given names, patronymics, e-mail addresses and ORCIDs
settle who is who among equal surnames.

Edge cases (tests/llm/test_names.py): rows without a name get no entity; null and empty attributes leave a row
undecided between several fitting people, and an undecided row stays alone; repeated rows count once; names of
any length are handled, the distance only ever fills a band; an empty table gives an empty result; extra
columns can't clash, as only named ones are read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.letters import latin
from lodeline.runtime import col, has_rows, sliced, spread, stored, unsent

# Given names with their short forms, in Latin letters.
GIVEN = {
    "sergey": "sergei sergej serge serezha seryozha seriozha", "mikhail": "mihail misha", "nikolai": "nikolay nikolaj kolya kolia", "vladimir": "volodya volodia vova", "ivan": "vanya vania",
    "pavel": "pasha", "dmitry": "dmitrii dmitri dmitriy dima", "alexander": "aleksandr aleksander sasha", "evgeny": "evgenii evgeniy eugeny zhenya zhenia", "grigory": "grigorii grigoriy grisha",
    "andrey": "andrei andrej andriusha", "alexey": "aleksei aleksey alesha alyosha", "petr": "pyotr petia petya", "boris": "borya boria", "viktor": "victor vitya vitia", "oleg": "", "fedor": "fyodor fedya fedia",
    "yuri": "iurii yury yuriy iura yura", "konstantin": "kostya kostia", "vasily": "vasilii vasia vasya", "igor": "", "leonid": "lenya",
    "tatiana": "tatyana tanya tania", "olga": "olya olia", "ekaterina": "katya katia", "anna": "anya ania", "maria": "mariia mariya masha", "elena": "yelena lena", "natalia": "nataliia natalya natasha", "irina": "ira", "svetlana": "sveta", "galina": "galya galia",
    "william": "bill will billy", "robert": "bob rob bobby", "thomas": "tom tommy", "michael": "mike mick", "edward": "ted ed eddie", "margaret": "peggy maggie meg", "katherine": "kate kathy catherine katharine", "elizabeth": "liz beth lizzie betty",
    "johannes": "hannes", "friedrich": "fritz", "jurgen": "juergen", "francois": "", "richard": "dick rick", "james": "jim jimmy", "john": "jack johnny", "charles": "charlie chuck", "heinrich": "heinz", "josef": "sepp joseph",
}
TITLES = set("dr prof professor phd ph d mr mrs ms ing dipl doc akad akademik doktor kand dtn ktn herr frau sir acad msc bsc".split()) - {"d"}
# Words of organisation names by the kind of organisation that they mark, and words that mark none.
KINDS = {
    "ore_geology": "ore rudnoi rud geology geologii geol geologicheskii", "hydrometallurgy": "hydrometallurgy gidrometallurgii hydromet gidromet", "water": "water vody vod", "furnace": "furnace pechei pech",
    "university": "university universitet univ un tekhnicheskii technical tech tekhn tu", "mineral_processing": "mineral processing miner proc obogashcheniia obogashch obog nts", "works": "mining smelting smelt wks works gorno metallurgicheskii kombinat gmk min metall",
    "furnace_design": "", "laboratory": "",
}
PLAIN = "institute institut inst in t laboratory laboratoriia lab design bureau konstruktorskoe biuro kb db engineering eng research centre center res ctr nauchnyi tsentr jsc fgup oao ooo zao pao ltd gmbh inc plc of for and the g gorod n k konstr nauch ts ao"
HOMOGLYPHS = str.maketrans("aceopxyABCEHKMOPTXyk", "асеорхуАВСЕНКМОРТХук")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
PATRONYMIC = re.compile(r"(?:[oe]vich|[oe]vna|ilich|mich|ichna)$")
DEGREE = re.compile(r"\b[кдkd]\.\s*(?:т|х|г\.?-?м|ф\.?-?м|э|ю|б|t|tekhn|г)\.\s*[нn]\.?|\bPh\.?\s?D\.?", re.I)
GLUED = re.compile(r"^([^\W\d_][^\W\d_]{3,}?)([A-ZА-ЯЁ]{1,2})$")
KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
COMMON = set(PLAIN.split())
CANON = {v: k for k, vs in GIVEN.items() for v in (k, *vs.split())}


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, within a band of ``most``; ``most`` + 1 for more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        if i <= most:
            new[0] = i
        best = new[0]
        for j in range(low, high + 1):
            v = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, two[j - 2] + 1)
            new[j] = v
            best = min(best, v)
        if best > most:
            return most + 1
        two, row = row, new
    return min(row[len(b)], most + 1)


def slips(length: int) -> int:
    """Edits allowed between spellings of a name of this length."""
    return 0 if length < 4 else 1 if length < 7 else 2


ORCID_NAMES = 3  # surnames that one ORCID may stand with


def segment_spans(length: int, k: int) -> list[tuple[int, int]]:
    size, extra = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = size + (i >= k + 1 - extra)
        out.append((at, n))
        at += n
    return out


def index_keys(name: str) -> set[str]:
    """Segments of an indexed name with its length and their number; there is one more than the slips that its length allows."""
    k = slips(len(name))
    return {f"{len(name)}.{i}.{name[p : p + n]}" for i, (p, n) in enumerate(segment_spans(len(name), k)) if n} if k else set()


def probe_keys(name: str) -> set[str]:
    """Substrings at shifted places that a name within the slips, of any nearby length, would have as a segment.

    A swap of neighbours is one slip but touches two segments where it lies between them, so the segments on
    both sides of a border are also looked up with the letters at the border swapped back.
    """
    out = set()
    most = slips(len(name) + 2)
    for length in range(max(1, len(name) - most), len(name) + most + 1):
        k = slips(length)
        if abs(length - len(name)) > k or not k:
            continue
        spans = segment_spans(length, k)
        for i, (p, n) in enumerate(spans):
            out.update(f"{length}.{i}.{name[q : q + n]}" for q in range(max(0, p - k), min(len(name) - n, p + k) + 1))
            for shift in range(-(k - 1), k):
                q = p + shift  # the border before this segment, as shifted by slips further ahead
                if i and 0 < q < len(name):
                    x = name[: q - 1] + name[q] + name[q - 1] + name[q + 1 :]
                    before = spans[i - 1][1]
                    if q >= before:
                        out.add(f"{length}.{i - 1}.{x[q - before : q]}")
                    if q + n <= len(x):
                        out.add(f"{length}.{i}.{x[q : q + n]}")
    return out


def one_script(word: str) -> str:
    """A word with letters of two scripts that look alike, put into one."""
    return word.translate(HOMOGLYPHS) if CYRILLIC.search(word) else word


def fold(word: str) -> str:
    """A spelling that doubled letters and the usual endings of transliterations don't change; the rest is left to edits."""
    x = re.sub(r"[^a-z]+", "", latin(word).lower())
    x = x.replace("w", "v").replace("shch", "sch").replace("x", "ks")
    x = re.sub(r"(?:skii|skij|skiy|ski|scy|sci|sky|zky)$", "ski", x)
    x = re.sub(r"off$", "ov", x)
    x = re.sub(r"(?:ii|ij|iy|yi|y|j)$", "i", x)
    return re.sub(r"(.)\1+", r"\1", x)


@lru_cache(200_000)
def given_name(word: str, cut: bool = False) -> str | None:
    """The full given name that a word spells, short forms and slips included; a word cut off by a dot may not slip."""
    if word in CANON:
        return CANON[word]
    if cut or len(word) < 3:
        return None
    known = CANON if len(word) >= 5 else GIVEN
    near = {CANON[x] for x in known if len(x) >= 4 and distance(word, x, 1) <= 1}
    return near.pop() if len(near) == 1 else None


def person(name: str | None) -> tuple[str, str, str] | None:
    """(folded surname, given name or its beginning, patronymic or its beginning) of a person's name as typed."""
    if not name:
        return None
    name = DEGREE.sub(" ", name)
    words: list[tuple[str, bool]] = []
    for m in WORD.finditer(name):
        w = one_script(m.group())
        dot = name[m.end() : m.end() + 1] == "."
        if latin(w).lower().replace("-", "") in TITLES and (len(w) > 1):
            continue
        g = GLUED.match(w) if not w.isupper() else None
        if g:
            words.append((g.group(1), False))
            words += [(ch, True) for ch in g.group(2)]
        else:
            words.append((w, dot))
    plain = [latin(w).lower() for w, _ in words]
    comma = name.find(",")
    surname = None
    caps = [i for i, (w, _) in enumerate(words) if len(w) > 2 and w.isupper()]
    first_part = len(WORD.findall(name[:comma])) if comma > 0 else 0
    patronymic = next((i for i, w in enumerate(plain) if len(w) > 5 and w not in CANON and PATRONYMIC.search(w)), None)
    given = next((i for i, w in enumerate(plain) if i != patronymic and len(w) > 2 and given_name(w, words[i][1])), None)
    long = [i for i, w in enumerate(plain) if len(w) > 1 and i not in (given, patronymic)]
    if patronymic is not None and not long and given is None:
        long, patronymic = [patronymic], None
    if comma > 0 and first_part == 1 and plain and len(plain[0]) > 3:
        surname = 0
        if given == 0:
            given = next((i for i, w in enumerate(plain) if i not in (0, patronymic) and given_name(w, words[i][1])), None)
    elif len(caps) == 1 and len(words) > 1 and caps[0] not in (given, patronymic):
        surname = caps[0]
    elif long:
        surname = max(long, key=lambda i: (len(plain[i]) > 3, not words[i][1], len(plain[i])))
    if surname is None:
        if given is None:
            return None
        surname, given = given, None
    rest = [i for i in range(len(plain)) if i not in (surname, given, patronymic)]
    letters = [plain[i] for i in rest if len(plain[i]) == 1 or (words[i][1] and len(plain[i]) <= 4) or len(plain[i]) <= 2]
    other = [plain[i] for i in rest if plain[i] not in letters]
    first = given_name(plain[given], words[given][1]) if given is not None else (other.pop(0) if other else letters.pop(0) if letters else "")
    second = plain[patronymic] if patronymic is not None else (letters.pop(0) if letters else other.pop(0) if other else "")
    f = fold(words[surname][0])
    return (f, first, second) if f else None


def fits(a: str, b: str) -> bool:
    """Whether two given names or patronymics may be the same, one possibly only begun."""
    if not a or not b or a.startswith(b) or b.startswith(a):
        return True
    if min(len(a), len(b)) <= 3:
        return len(a) > 3 and CANON.get(b) == a or len(b) > 3 and CANON.get(a) == b
    return distance(a, b, 1) <= 1 or a[:4] == b[:4] and bool(PATRONYMIC.search(a) and PATRONYMIC.search(b))


@lru_cache(100_000)
def _org_word(word: str) -> str | None:
    """The kind a word marks, '' for a common word, None for a name."""
    if word in KIND_OF:
        return KIND_OF[word]
    if word in COMMON or len(word) < 3:
        return ""
    for x in (*KIND_OF, *COMMON):
        if len(x) >= 4 and len(word) >= 4 and (distance(word, x, slips(len(x))) <= slips(len(x)) or (len(word) >= 4 and x.startswith(word))):
            return KIND_OF.get(x, "")
    return None


def organisation(name: str | None) -> tuple[str, str] | None:
    """(folded place, kind) of an organisation's name as typed."""
    if not name:
        return None
    votes: dict[str, int] = defaultdict(int)
    place = ""
    for m in WORD.finditer(name):
        for w in latin(one_script(m.group())).lower().split("-"):
            k = _org_word(w)
            if k is None:
                f = fold(w)
                place = f if len(f) > len(place) else place
            elif k:
                votes[k] += 1
    # a word such as "technical" or "mining" also stands in other names, so the kind with most marks wins
    kind = max(votes, key=lambda k: (votes[k], k)) if votes else ""
    return (place, kind) if place else None


def _near_spellings(names: DataFrame, group: str | None) -> DataFrame:
    """(group, name, target): each distinct spelling and the most frequent one within its slips, by the segment join.

    ``names`` has (group, name, n). Two rounds let a spelling reach its target over one step between.
    """
    base = names if group else names.withColumn("grp", F.lit(""))
    base = base.withColumnRenamed(group, "grp") if group else base
    keyed = base.mapInArrow(_index, "grp string, name string, n bigint, key string")
    probes = base.mapInArrow(_probe, "grp string, name string, n bigint, key string")
    pairs = (
        probes.alias("p").join(unsent(keyed).alias("i"), (F.col("p.grp") == F.col("i.grp")) & (F.col("p.key") == F.col("i.key")))
        .where((F.col("i.n") > F.col("p.n")) | ((F.col("i.n") == F.col("p.n")) & (F.col("i.name") < F.col("p.name"))))
        .select("p.grp", "p.name", F.col("i.name").alias("target"), F.col("i.n").alias("m")).distinct()
    )
    good = pairs.mapInArrow(_check, "grp string, name string, target string, m bigint, d int")
    step = good.groupBy("grp", "name").agg(F.min_by("target", F.struct("d", -F.col("m"), "target")).alias("target"))
    step = stored(step, "near")
    for _ in range(2):
        up = step.select("grp", F.col("name").alias("target"), F.col("target").alias("further"))
        step = step.join(unsent(up), ["grp", "target"], "left").select("grp", "name", F.coalesce("further", "target").alias("target"))
    out = base.join(unsent(step), ["grp", "name"], "left").select("grp", "name", F.coalesce("target", "name").alias("target"))
    return stored(out.withColumnRenamed("grp", group) if group else out.drop("grp"), "spellings")


def _keys(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("name", pa.string()), ("n", pa.int64()), ("key", pa.string())])
    for b in batches:
        rows = ((g, w, n, k) for g, w, n in zip(b["grp"].to_pylist(), b["name"].to_pylist(), b["n"].to_pylist()) for k in make(w))
        yield from sliced(rows, schema)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keys(batches, index_keys)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _keys(batches, probe_keys)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for g, a, t, m in zip(*(b[c].to_pylist() for c in ("grp", "name", "target", "m"))):
            most = slips(min(len(a), len(t)))
            if (d := distance(a, t, most)) <= most:
                rows.append((g, a, t, m, d))
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()))], ["grp", "name", "target", "m", "d"])


def settle(profiles: list[dict]) -> list[int | None]:
    """Person numbers for the distinct profiles (kind, given, patronymic) of one surname at one place.

    Full given names make people, split where kinds or patronymics contradict; a shorter profile joins the one
    person it fits, or its like where it fits nobody; between several it stays undecided.
    """
    people: list[list[dict]] = []
    order = sorted(range(len(profiles)), key=lambda i: (-(len(profiles[i]["given"]) > 3), -len(profiles[i]["patronymic"]), -bool(profiles[i]["kind"]), profiles[i]["given"], profiles[i]["patronymic"], profiles[i]["kind"]))
    out: list[int | None] = [None] * len(profiles)

    def agrees(p: dict, group: list[dict]) -> bool:
        return all(fits(p["given"], q["given"]) and fits(p["patronymic"], q["patronymic"]) and (not p["kind"] or not q["kind"] or p["kind"] == q["kind"]) for q in group)

    waiting = []
    for i in order:
        p = profiles[i]
        match = [k for k, g in enumerate(people) if agrees(p, g)]
        if len(match) == 1:
            out[i] = match[0]
            people[match[0]].append(p)
        elif not match:
            out[i] = len(people)
            people.append([p])
        else:
            waiting.append((i, match))
    return out


def _people(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for place, surname, profiles in zip(b["place"].to_pylist(), b["surname"].to_pylist(), b["profiles"].to_pylist()):
            for p, k in zip(profiles, settle(profiles)):
                rows.append((place, surname, p["kind"], p["given"], p["patronymic"], None if k is None else f"p:{place}:{surname}:{k}"))
        yield pa.record_batch([pa.array([r[j] for r in rows], pa.string()) for j in range(6)], ["place", "surname", "kind", "given", "patronymic", "entity"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "is_org", "place", "kind", "surname", "given", "patronymic", "email", "orcid"]
    for b in batches:
        rows = []
        for key, raw, norm, is_org, aff, email, orcid in zip(*(b[c].to_pylist() for c in ("id", "raw", "norm", "is_org", "aff", "email", "orcid"))):
            org = organisation(raw) or organisation(norm) if is_org else None
            if not is_org:
                for a in aff or ():
                    org = org or organisation(a)
                if not org and email and "@" in email:
                    org = (fold(email.rpartition("@")[2].split(".")[0]), "")
            p = None
            if not is_org:
                p, q = person(raw), person(norm)
                if p is None:
                    p = q
                elif q and q[0] == p[0]:
                    p = (p[0], *(y if len(y) > len(x) and fits(x, y) else x for x, y in zip(p[1:], q[1:])))
            place, kind = org or ("", "")
            surname, given, patronymic = p or ("", "", "")
            rows.append((key, is_org, place, kind, surname, given, patronymic, (email or "").lower() or None, orcid or None))
        types = [pa.string(), pa.bool_(), *[pa.string()] * 7]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names)


def entities(df: DataFrame, id_col: str = "author_id", raw_col: str = "raw_name", normal_col: str = "normalized_name", affiliation_col: str = "affiliations", email_col: str = "email", orcid_col: str = "orcid", role_col: str = "role") -> DataFrame:
    """(id, entity) of every spelling that could be settled; equal entities mean the same person or organisation."""
    pick = {"raw": raw_col, "norm": normal_col, "email": email_col, "orcid": orcid_col}
    base = df.select(col(id_col).cast("string").alias("id"), *(F.nullif(F.trim(col(c)), F.lit("")).alias(n) for n, c in pick.items()), col(affiliation_col).alias("aff"), (col(role_col) == "organization").alias("o")).where("id is not null")
    one = base.groupBy("id").agg(*(F.max(n).alias(n) for n in pick), F.max("aff").alias("aff"), F.coalesce(F.max("o"), F.lit(False)).alias("is_org"))
    parsed = stored(spread(one).mapInArrow(_parsed, "id string, is_org boolean, place string, kind string, surname string, given string, patronymic string, email string, orcid string"), "parsed")

    places = parsed.where("place <> ''").groupBy(F.col("place").alias("name")).agg(F.count("*").alias("n"))
    place_of = _near_spellings(places, None).select(F.col("name").alias("place"), F.col("target").alias("at"))
    rows = stored(parsed.join(unsent(place_of), "place", "left").withColumn("place", F.coalesce("at", F.lit(""))).drop("at"), "placed")

    orgs = rows.where("is_org and place <> ''")
    kinds = orgs.where("kind <> ''").groupBy("place").agg(F.min("kind").alias("only"), F.count_distinct("kind").alias("k"))
    org_entity = (
        orgs.join(unsent(kinds), "place", "left").withColumn("kind", F.when(F.col("kind") != "", F.col("kind")).when(F.col("k") == 1, F.col("only")).otherwise(F.lit("")))
        .select("id", F.concat_ws(":", F.lit("o"), "place", "kind").alias("entity"))
    )

    people = rows.where("not is_org and surname <> ''")
    surnames = people.where("place <> ''").groupBy("place", F.col("surname").alias("name")).agg(F.count("*").alias("n"))
    surname_of = _near_spellings(surnames, "place").select("place", F.col("name").alias("surname"), F.col("target").alias("as"))
    local = stored(people.where("place <> ''").join(unsent(surname_of), ["place", "surname"]).withColumn("surname", F.col("as")).drop("as"), "local")
    profiles = local.groupBy("place", "surname").agg(F.collect_set(F.struct("kind", "given", "patronymic")).alias("profiles"))
    known = stored(profiles.mapInArrow(_people, "place string, surname string, kind string, given string, patronymic string, entity string"), "people")
    placed = local.join(unsent(known), ["place", "surname", "kind", "given", "patronymic"]).select("id", "email", "orcid", "surname", "entity")

    # people without a place: the segment join against all surnames with the same initial, or all where it is missing
    initial = F.substring("given", 1, 1)
    lost = stored(people.where("place = ''").select("id", F.concat(initial, F.lit("|")).alias("grp"), F.col("surname").alias("name"), "given", "patronymic", "email", "orcid"), "lost")
    lost_profiles = lost.select("grp", "name", "given", "patronymic").distinct()
    lost_names = lost.select("grp", "name").distinct().withColumn("n", F.lit(0).cast("bigint"))
    full = known.where("entity is not null").withColumn("grp", F.explode(F.array_distinct(F.array(F.concat(initial, F.lit("|")), F.lit("|")))))
    full_names = full.select("grp", F.col("surname").alias("name")).distinct().withColumn("n", F.lit(1).cast("bigint"))
    near = (
        lost_names.mapInArrow(_probe, "grp string, name string, n bigint, key string").alias("p")
        .join(unsent(full_names.mapInArrow(_index, "grp string, name string, n bigint, key string")).alias("i"), (F.col("p.grp") == F.col("i.grp")) & (F.col("p.key") == F.col("i.key")))
        .select("p.grp", "p.name", F.col("i.name").alias("target"), F.col("i.n").alias("m"))
        .unionByName(lost_names.join(unsent(full_names.select("grp", "name", F.col("n").alias("m"))), ["grp", "name"]).select("grp", "name", F.col("name").alias("target"), "m")).distinct()
        .mapInArrow(_check, "grp string, name string, target string, m bigint, d int")
    )
    options = lost_profiles.join(unsent(near), ["grp", "name"]).join(unsent(full.select("grp", F.col("surname").alias("target"), F.col("given").alias("g"), F.col("patronymic").alias("pa"), "entity")), ["grp", "target"])
    profile = ["name", "given", "patronymic"]
    fitting = options.mapInArrow(_fitting, "name string, given string, patronymic string, entity string, d int")
    best = fitting.groupBy(*profile, "d").agg(F.min("entity").alias("a"), F.max("entity").alias("b")).groupBy(*profile).agg(F.min_by(F.struct("a", "b"), "d").alias("x"))
    alike = F.when((F.length("given") > 3) & (F.col("patronymic") != ""), F.concat_ws(":", F.lit("q"), "name", "given", F.substring("patronymic", 1, 1)))
    found = (
        lost.join(unsent(best), profile, "left")
        .select("id", "email", "orcid", F.col("name").alias("surname"), F.when(F.col("x.a") == F.col("x.b"), F.col("x.a")).when(F.col("x").isNull(), alike).alias("entity"))
    )

    # e-mail addresses and ORCIDs settle what is still open
    every = stored(placed.unionByName(found), "every")
    for c in ("orcid", "email"):
        by = every.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("entity").alias("seen"), F.min("id").alias("any"))
        every = every.join(unsent(by), c, "left").withColumn("entity", F.coalesce("entity", "seen", F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), "any")))).select("id", "email", "orcid", "surname", "entity")
    every = stored(every.where("entity is not null"), "settled")
    one = _joined(every)
    settled = every.join(unsent(one), "entity", "left").select("id", F.coalesce("first", "entity").alias("entity"))
    return settled.unionByName(org_entity)


def _joined(every: DataFrame) -> DataFrame:
    """(entity, first) of the entities that ORCIDs join to others, by passing the first name on until nothing changes.

    An ORCID with more than ORCID_NAMES surnames is a placeholder and joins nobody.
    """
    marked = every.where("orcid is not null")
    several = marked.groupBy("orcid").agg(F.min("entity").alias("x"), F.max("entity").alias("y"), F.count_distinct("surname").alias("n")).where((F.col("x") != F.col("y")) & (F.col("n") <= ORCID_NAMES))
    links = stored(marked.select("orcid", "entity").distinct().join(several.select("orcid"), "orcid"), "orcids")
    label = stored(links.select("entity", F.col("entity").alias("first")).distinct(), "label")
    while True:
        least = links.join(label, "entity").groupBy("orcid").agg(F.min("first").alias("first"))
        new = stored(links.join(least, "orcid").groupBy("entity").agg(F.min("first").alias("first")), "label")
        if not has_rows(new.join(label, ["entity", "first"], "left_anti")):
            return new
        label = new


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(n, g, p, e, d) for n, g, p, h, q, e, d in zip(*(b[c].to_pylist() for c in ("name", "given", "patronymic", "g", "pa", "entity", "d"))) if fits(g, h) and fits(p, q)]
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((*[pa.string()] * 4, pa.int32()))], ["name", "given", "patronymic", "entity", "d"])


def pairs(linked: DataFrame, a: str = "author_id_a", b: str = "author_id_b") -> DataFrame:
    """All pairs (a < b) of spellings of one entity; an entity has as many as it has spellings, which are few."""
    x = linked.select("entity", F.col("id").alias(a))
    y = linked.select("entity", F.col("id").alias(b))
    return x.join(y, "entity").where(F.col(a) < F.col(b)).select(a, b)
