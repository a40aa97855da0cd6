"""Operator 1, surrogate generation for personal data.

Detected entities are replaced by keyed surrogates of the same type and format:
digits stay digits, letters stay letters of the same case, separators, country
codes, issuer digits, key prefixes and top-level domains stay, a card number that
passes its checksum gets one that does.  Names after a title, or several ("Prof. Dr."),
get made-up names of the titles' gender and of their own script, first and last names
each by themselves, so "Mr. Ann Lee" and "Mr. Lee" stay one person.  Names are also found
after a salutation ("Dear Ann Lee,"), below a closing ("Regards, Ann Lee") and in a
name field ("Name: Ann Lee"); of such a name no gender is known.  In a document that
names someone, every capitalised whole-word mention of that name is replaced too,
wherever it stands; in scripts without case, every mention as a word of its own.  A name
that no title, salutation, closing or field goes with in its document isn't found.

A name is given or family, and a given name has a gender, as its document says most often
and then as the corpus does: a given name with a gender before one without, and that before
a family name.  The kind shapes the made name but isn't part of its key, so a name has one
surrogate whatever stands before it in one place or another.

A surrogate is a function of (key, type, value): equal values get equal surrogates
everywhere (coreference), without a table.  For all types but names it is a keyed
permutation of all values of the value's format, so different values never meet.
The collision check runs over the distinct entities of the corpus: a surrogate
that is itself an entity of the corpus, or a name surrogate that two values share,
is made again with the next tweak until none is left.  Made names get longer as
tweaks rise; a format of which the corpus holds more than half of all values, so that
no free one may be left, is widened by digits.  Only documents that hold such an
entity are given the tweak; there are few.

Defined cases: null text stays null and has no entities; a text is replaced whole,
whatever its length; overlapping matches go to the earlier, then the first pattern
in order; null and repeated identifiers are handled row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.words import small_batches
from linkloom.operators.iterate import cut
from linkloom.operators.joins import join_side_table

# Titles and the gender they state.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
          "Mme": "f", "Señor": "m", "Señora": "f", "Don": "m", "Doña": "f", "Dr": "", "Prof": "", "господин": "m", "госпожа": "f",
          "κύριος": "m", "κυρία": "f"}
NAME = r"[^\W\d_][^\W\d_'’-]*(?:[-'’][^\W\d_]+)*"
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("accesskey", r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)"),
    ("secret", r"(?i:(?<!\w)(?:password|passwd|pwd|secret|api[_-]?key|token)\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[^\s\"',;]{6,})"),
    ("hexkey", r"(?<!\w)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?!\w)"),
    ("card", r"(?<![\w.])[3-6]\d(?:[ -]?\d){11,17}(?!\w)"),
    ("phone", r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
              r"|(?<!\w)\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w)"),
    ("cue", rf"(?<!\w)(?:Dear|Hello|Hi) (?P<greeted>{NAME}(?: {NAME}){{0,2}})(?=\s?[,:!])"
            rf"|(?<!\w)(?:[Rr]egards|[Ss]incerely|[Cc]heers|[Bb]est wishes|[Yy]ours truly|[Yy]ours faithfully),\s{{1,3}}(?P<signed>{NAME}(?: {NAME}){{0,2}})"
            rf"|(?<!\w)(?:[Ff]ull |[Ff]irst |[Ll]ast |[Gg]iven |[Ff]amily )?(?:[Nn]ame|[Ss]urname): {{0,3}}(?P<field>{NAME}(?: {NAME}){{0,2}})"),
    ("name", rf"(?<!\w)(?P<title>(?:(?:{'|'.join(TITLES)})\.? )+)(?P<name>{NAME}(?: {NAME}){{0,2}})"),
]
# consonants and vowels from which names are made, by script
SCRIPTS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρτ", "αεηιο")}
# letters of scripts without case, as ranges of code points, and a pattern of their names
CASELESS = {"han": ("[\u4e00-\u9fff]", 0x4E00, 0x5000), "hangul": ("[\uac00-\ud7a3]", 0xAC00, 0xAE00), "hiragana": ("[\u3041-\u3096]", 0x3042, 0x3094),
            "katakana": ("[\u30a1-\u30fa]", 0x30A2, 0x30F4), "hebrew": ("[\u05d0-\u05ea]", 0x05D0, 0x05EB), "arabic": ("[\u0620-\u064a]", 0x0628, 0x063B),
            "devanagari": ("[\u0904-\u0939]", 0x0915, 0x093A), "thai": ("[\u0e01-\u0e2e]", 0x0E01, 0x0E2F)}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


WIDE, ROUNDS = 1 << 16, 64

DIGIT_OR_AT = re.compile("[0-9@]")
KEY_HEADS = ("AKIA", "ASIA")
CUES = ("Dear ", "Hello ", "Hi ", "egards,", "incerely,", "heers,", "est wishes,", "ours truly,", "ours faithfully,", "ame:")
NOBODY = {"all", "both", "colleague", "colleagues", "customer", "customers", "everybody", "everyone", "folks", "friend", "friends", "guys",
          "madam", "reader", "readers", "sir", "sirs", "team", "there", "world", *(t.lower() for t in TITLES)}
MENTION = re.compile(rf"(?<!\w){NAME}(?!\w)")
OWNED = re.compile("['’][sS]$")
SECRET_WORDS = ("passw", "pwd", "secret", "key", "token")


def windows(text: str):
    """Disjoint stretches, cut at spaces, around everything that an entity must hold:
    a digit, an at sign, a secret's name or a title.  The rest needs no look."""
    places = [m.start() for m in DIGIT_OR_AT.finditer(text)]
    lower = text.lower()
    for where, words in ((lower, SECRET_WORDS), (text, (*TITLES, *KEY_HEADS, *CUES))):
        for word in words:
            at = where.find(word)
            while at >= 0:
                places.append(min(at, len(text)))
                at = where.find(word, at + 1)
    lo = hi = -1
    for at in sorted(places):
        begin = text.rfind(" ", 0, max(0, at - 60)) + 1
        if hi < 0 or begin > hi:
            if hi >= 0:
                yield lo, hi
            lo = begin
        if at + 100 > hi:
            stop = text.find(" ", at + 100)
            hi = len(text) if stop < 0 else stop
    if hi >= 0:
        yield lo, hi


def bare(word: str) -> str:
    """A name without the s of its owner's case."""
    return OWNED.sub("", word)


def named(word: str) -> bool:
    """Begins like a name: a capital, or a letter of a script without case."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def is_name(kind: str) -> bool:
    return kind.startswith(("given", "family"))


def settled(votes: Counter) -> str:
    """The one kind of a name that was seen as several."""
    gendered = [k for k in ("givenf", "givenm") if votes[k]]
    if gendered:
        return max(gendered, key=lambda k: (votes[k], k))
    return "given" if votes["given"] else "family"


def detected(text: str, pattern: re.Pattern):
    """(type, begin, end) of what the patterns find, in order of place."""
    for m in (m for lo, hi in windows(text) for m in pattern.finditer(text, lo, hi)):
        kind = m.lastgroup
        if m.group("secret"):
            yield "secret", *m.span("secret")
        elif where := next((g for g in ("name", "greeted", "signed", "field") if m.group(g)), None):
            genders = [TITLES[t] for t in re.findall(r"[^\W\d_]+", m.group("title"))] if where == "name" else []
            gender, (begin, _) = next(filter(None, genders), ""), m.span(where)
            parts = [w for w in re.finditer(NAME, m.group(where)) if named(w[0])]
            if not parts or parts[0].start() or (where != "name" and any(w[0].lower() in NOBODY for w in parts)):
                continue
            for k, w in enumerate(parts):
                yield ("family" if k == len(parts) - 1 else f"given{gender}"), begin + w.start(), begin + w.start() + len(bare(w[0]))
        else:
            yield kind, *m.span()


def entities(text: str, pattern: re.Pattern) -> list:
    """(type, begin, end) in order of place: what is detected, and all mentions of the names among it."""
    found = list(detected(text, pattern))
    seen: dict = {}
    for kind, f, t in found:
        if is_name(kind):
            seen.setdefault(canonical(kind, text[f:t]), Counter())[kind] += 1
    if not seen:
        return found
    names = {name: settled(votes) for name, votes in seen.items()}
    found = [(names[canonical(kind, text[f:t])] if is_name(kind) else kind, f, t) for kind, f, t in found]
    held, more = 0, []
    for m in MENTION.finditer(text):
        word = bare(m[0])
        kind = names.get(word.lower()) if named(word) else None
        if not kind:
            continue
        f, t = m.start(), m.start() + len(word)
        while held < len(found) and found[held][2] <= f:
            held += 1
        if held == len(found) or found[held][1] >= t:
            more.append((kind, f, t))
    return sorted([*found, *more], key=lambda x: x[1])


def compiled() -> re.Pattern:
    return re.compile("|".join(f"(?P<{kind}>{p})" if kind not in ("secret", "cue", "name") else f"(?:{p})" for kind, p in PATTERNS))


def canonical(kind: str, raw: str) -> str:
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"[ ().-]", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    return raw.lower() if kind == "email" or kind.startswith(("given", "family")) else raw


def number(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def widened(key: bytes, kind: str, value: str, tweak: int) -> str:
    """Digits by which a surrogate outgrows its format: a tweak holds their number above ``WIDE``."""
    w = tweak // WIDE
    return f"{number(key, 'wide', kind, tweak, value) % 10 ** w:0{w}d}" if w else ""


def space_of(kind: str, value: str) -> tuple[str, int]:
    """A canonical value's format, and how many values that has."""
    if kind == "ip":
        return kind, 1 << 32
    (a, b), alphabets = fixed_part(kind, value), alphabets_of(kind, value)
    inner, size = value[a:len(value) - b], 1
    for x in alphabets:
        size *= len(x or "1")
    shape = "".join(str(len(x)) if x else c for x, c in zip(alphabets, inner))
    return f"{value[:a]}|{shape}|{value[len(value) - b:] if b and kind != 'card' else b}", size


def alphabets_of(kind: str, value: str) -> list:
    """For each character that isn't fixed, those it may become; None where it stays."""
    a, b = fixed_part(kind, value)
    inner = value[a:len(value) - b]
    if kind in ("secret", "hexkey") and re.fullmatch(r"[0-9a-f]+", inner):
        return ["0123456789abcdef"] * len(inner)
    if kind == "accesskey":
        return [ALPHABETS[2] + ALPHABETS[0]] * len(inner)
    return [next((x for x in ALPHABETS if c in x), None) for c in inner]


def permuted(key: bytes, label: str, digits: list[int], radix: list[int]) -> list[int]:
    """Keyed permutation of all mixed-radix numbers with these radices: six rounds
    that add a keyed function of one half to the other."""
    k = len(digits) // 2
    sizes, halves = [1, 1], [0, 0]
    for i, (d, r) in enumerate(zip(digits, radix)):
        s = i >= k
        halves[s], sizes[s] = halves[s] * r + d, sizes[s] * r
    for turn in range(6):
        a, b = (0, 1) if turn % 2 else (1, 0)
        halves[a] = (halves[a] + number(key, label, turn, halves[b])) % sizes[a]
    out = []
    for i in range(len(digits) - 1, -1, -1):
        s = i >= k
        halves[s], d = divmod(halves[s], radix[i])
        out.append(d)
    return out[::-1]


def luhn(digits: str) -> int:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def fixed_part(kind: str, value: str) -> tuple[int, int]:
    """Characters at both ends that stay."""
    if kind == "email":
        return 0, len(value) - value.rindex(".")
    if kind == "card":
        return 1, int(luhn(value[:-1]) == int(value[-1]))
    if kind == "phone" and value[0] == "+":
        return len(value) - 10 if len(value) > 11 else 2, 0
    return {"iban": 2, "accesskey": 4}.get(kind, 0), 0


def surrogate(key: bytes, kind: str, value: str, tweak: int = 0) -> str:
    """Surrogate of a canonical value."""
    if kind.startswith(("given", "family")):
        return made_name(key, kind, value, tweak)
    if kind == "ip":
        octets = permuted(key, f"{kind}{tweak}", [int(x) for x in value.split(".")], [256] * 4)
        return ".".join(map(str, octets)) + "".join(f".{d}" for d in widened(key, kind, value, tweak))
    a, b = fixed_part(kind, value)
    inner, alphabets = value[a:len(value) - b], alphabets_of(kind, value)
    places = [i for i, x in enumerate(alphabets) if x]
    shape = "".join(str(len(alphabets[i])) if alphabets[i] else inner[i] for i in range(len(inner)))
    got = permuted(key, f"{kind}{tweak}|{value[:a]}|{shape}|{value[len(value) - b:] if b and kind != 'card' else ''}",
                   [alphabets[i].index(inner[i]) for i in places], [len(alphabets[i]) for i in places])
    out = list(inner)
    for i, d in zip(places, got):
        out[i] = alphabets[i][d]
    body = value[:a] + "".join(out) + widened(key, kind, value, tweak)
    if kind == "card" and b:
        return body + str(luhn(body))
    return body + value[len(value) - b:]


def made_name(key: bytes, kind: str, value: str, tweak: int) -> str:
    x, out = number(key, "name", tweak, value), ""
    for pattern, low, high in CASELESS.values():
        if re.search(pattern, value):
            for _ in range(max(2, len(value)) + tweak // 4):
                x, c = divmod(x, high - low)
                out += chr(low + c)
            return out
    script = "cyrillic" if re.search("[а-яё]", value) else "greek" if re.search("[α-ωά-ώ]", value) else "latin"
    consonants, vowels = SCRIPTS[script]
    for _ in range((3 if kind.startswith("given") else 4) + tweak // 4):
        x, c = divmod(x, len(consonants))
        x, v = divmod(x, len(vowels))
        out += consonants[c] + vowels[v]
    if kind == "givenf":
        return out[:-1] + vowels[0]
    if kind == "givenm":
        return out + consonants[x % len(consonants)]
    return out


def in_format(kind: str, raw: str, new: str) -> str:
    """A canonical surrogate written as the original is: separators and case."""
    if kind.startswith(("given", "family")):
        return new.upper() if raw.isupper() and len(raw) > 1 else new.capitalize()
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(raw, new)) + new[len(raw):]
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(new)
        return "".join([c if c in " ().-" else next(rest) for c in raw]) + "".join(rest)
    return new


def distinct_entities(rows: DataFrame) -> DataFrame:
    def run(batches):
        pattern = compiled()
        for b in batches:
            keys, kinds, values = [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                for kind, value in {(k, canonical(k, text[f:t])) for k, f, t in entities(text, pattern)} if text else ():
                    keys.append(key)
                    kinds.append(kind)
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["key", "kind", "value"])

    return rows.mapInArrow(run, "key long, kind string, value string")


def assigned(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, tweak, sur) for distinct (kind, value) with their tweak."""
    def run(batches):
        for b in batches:
            sur = [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sur, pa.string())], ["kind", "value", "tweak", "sur"])

    return values.select("kind", "value", F.col("tweak").cast("int").alias("tweak")).mapInArrow(run, "kind string, value string, tweak int, sur string")


def crowded(values: DataFrame) -> DataFrame:
    """(kind, value) of the formats of which the corpus holds more than half of all values."""
    def run(batches):
        for b in batches:
            spaces = [space_of(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in spaces], pa.string()), pa.array([float(n) for _, n in spaces], pa.float64())],
                                             ["kind", "value", "format", "size"])

    rows = values.filter("NOT startswith(kind, 'given') AND kind <> 'family'").select("kind", "value").mapInArrow(
        run, "kind string, value string, format string, size double")
    full = rows.groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("most")).filter("2 * n > most")
    return rows.join(full, ["kind", "format"], "left_semi").select("kind", "value")


def family(kind):
    """Names of all kinds are one space of values."""
    return F.regexp_replace(kind, "^(given.?|family)$", "name")


def one_kind(kinds: DataFrame) -> DataFrame:
    """(value, settled) of the names among (kind, value, n), over the whole corpus."""
    n = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in ("givenf", "givenm", "given")}
    best = F.when((n["givenf"] > 0) | (n["givenm"] > 0), F.when(n["givenm"] >= n["givenf"], "givenm").otherwise("givenf")).when(n["given"] > 0, "given").otherwise("family")
    return kinds.filter(family(F.col("kind")) == "name").groupBy("value").agg(best.alias("settled"))


def retried(values: DataFrame, key: bytes) -> DataFrame:
    """The entities (kind, value, tweak) whose first surrogate collides, with the tweak that doesn't."""
    known = values.select(family(F.col("kind")).alias("space"), F.col("value").alias("sur")).distinct()
    now = cut(assigned(values.withColumn("tweak", F.lit(0)), key))
    full = None
    for tweak in itertools.count(1):
        spaced = now.withColumn("space", family(F.col("kind")))
        taken = spaced.groupBy("space", "sur").agg(F.min(F.struct("tweak", "value", "kind")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        clash = spaced.join(known, ["space", "sur"], "left_semi").select("kind", "value").unionByName(
            spaced.join(taken, ["space", "sur"]).filter(F.struct("tweak", "value", "kind") != F.col("first")).select("kind", "value")).distinct()
        clash = cut(clash)
        if clash.isEmpty():
            break
        full = full or cut(crowded(values).withColumn("full", F.lit(True)))
        # a format that is nearly full, if not provably, is widened after many rounds
        name = F.col("kind").startswith("given") | (F.col("kind") == "family")
        wide = F.when(name, 0).when(F.col("full"), tweak).otherwise(max(0, tweak - ROUNDS))
        again = clash.join(full, ["kind", "value"], "left").withColumn("tweak", F.lit(tweak) + F.lit(WIDE) * wide)
        now = cut(now.join(clash, ["kind", "value"], "left_anti").unionByName(assigned(again, key)))
    return now.filter("tweak > 0").select("kind", "value", "tweak")


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text, n_entities, entities (kind, begin, end in the new text)."""
    rows = small_batches(docs).select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    found = cut(distinct_entities(rows.select("key", "text")))
    kinds = cut(found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))
    is_a_name = family(F.col("kind")) == "name"
    kinds = cut(kinds.join(one_kind(kinds), "value", "left").select("kind", "value", F.when(is_a_name, F.col("settled")).otherwise(F.col("kind")).alias("as")))
    tweaks = cut(retried(cut(kinds.select(F.col("as").alias("kind"), "value").distinct()), key))
    changes = kinds.join(tweaks.withColumnRenamed("kind", "as"), ["as", "value"], "left").select("kind", "value", "as", F.coalesce("tweak", F.lit(0)).alias("tweak"))
    changes = cut(changes.filter((F.col("tweak") > 0) | (F.col("as") != F.col("kind"))))
    if changes.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,value:string,as:string,tweak:int>>"))
    else:
        of_doc = join_side_table(found, changes, ["kind", "value"], spread_key="key").dropDuplicates(["key", "kind", "value"]).groupBy("key").agg(
            F.collect_list(F.struct("kind", "value", "as", "tweak")).alias("again"))
        rows = rows.join(of_doc, "key", "left")
    rows = rows.select("doc_id", "text", "again")

    def run(batches):
        pattern = compiled()
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts, spans = [], []
            for text, again in zip(b.column(1), b.column(2).to_pylist()):
                text = text.as_py()
                changed = {(x["kind"], x["value"]): (x["as"], x["tweak"]) for x in again or ()}
                at, size, out, span = 0, 0, [], []
                for kind, f, t in entities(text, pattern) if text else ():
                    value = canonical(kind, text[f:t])
                    kind, tweak = changed.get((kind, value), (kind, 0))
                    new = in_format(kind, text[f:t], surrogate(key, kind, value, tweak))
                    out += [text[at:f], new]
                    size += f - at
                    span.append({"kind": kind, "begin": size, "end": size + len(new)})
                    size, at = size + len(new), t
                texts.append("".join([*out, text[at:]]) if text else text)
                spans.append(span)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(s) for s in spans], pa.int32()),
                                              pa.array(spans, kind_of)], ["doc_id", "text", "n_entities", "entities"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_type}, text string, n_entities int, entities array<struct<kind:string,begin:int,end:int>>")
