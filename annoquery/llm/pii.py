"""Surrogates for personal data and secrets.

Entities are found by patterns and checked: e-mail, phone, payment card (Luhn digit), IBAN (mod-97 digits), IP addresses of both versions (not
after "version" and the like), access key, password, national number, and persons named after a title. In a document that names a person
after a title, its later mentions without one, and the family name alone, are the same person. Each entity gets a keyed surrogate of its
type: letters become letters of the same case and script, digits digits, marks stay; check digits stay valid, addresses stay addresses,
persons get names of the gender their title tells and of their script. An entity is the same wherever it occurs (its canonical form), so
mentions stay coreferent. The key comes from the caller or from the setting ``spark.annoquery.surrogateKey``; without either, one is drawn for the call.

Collision check: a surrogate that another entity also has, or that is itself an entity of the corpus, is drawn again with
the next attempt number, until all differ. From attempt 3 on a surrogate grows by one drawn letter or digit an attempt (an
IP address first leaves its digit counts, then its version), so short values don't run out of surrogates. A value of marks only has no shape to keep: its
marks become drawn letters and digits, inside its quotes or brackets. Distinct entities are counted and compared by shuffles; texts are rewritten in one
narrow pass with the few entities that needed more than one attempt (broadcast while few, else joined by document).

Null texts stay null; empty texts stay empty; tables without rows give none; repeated rows are rewritten alike.
"""

from __future__ import annotations

import hashlib
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import staged, task

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9]{20,}\b"),
    ("password", r"(?i:\b(?:password|passwd|pwd|secret|token|api_key))[ \t]*[=:][ \t]*[^\s,;]+"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    ("card", r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)"),
    ("national", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"),
    ("person", r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Señora?)\b\.? [^\W\d_]\w+(?: [^\W\d_a-zà-ÿ]\w+)?"),
]
PATTERNS[3:3] = [
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
]
_NO_ADDRESS = re.compile(r"(?i)(?:\bversion|\brelease|\bv|\bver|§|\bsection|\bchapter)\.?[ \t]*$")
_FIND = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS))

#: Every mention has one of these in its line, and no mention crosses a line; other lines are passed over.
_TRIGGER = re.compile(r"[@0-9=:]|AKIA|ASIA|gh[pousr]_|sk-")

# Titles by gender, and given names by gender and script.
MALE, FEMALE = {"Mr", "Herr", "Monsieur", "Señor"}, {"Mrs", "Ms", "Miss", "Frau", "Madame", "Señora"}
GIVEN = {
    ("m", "latin"): ["Adrian", "Bruno", "Carlo", "Dario", "Emil", "Felix", "Hugo", "Leon"],
    ("f", "latin"): ["Alma", "Bianca", "Clara", "Dora", "Elena", "Freya", "Ines", "Nora"],
    ("m", "cyrillic"): ["Антон", "Борис", "Денис", "Егор"],
    ("f", "cyrillic"): ["Алина", "Вера", "Дарья", "Елена"],
    ("m", "greek"): ["Νίκος", "Πέτρος", "Σπύρος"],
    ("f", "greek"): ["Ελένη", "Μαρία", "Σοφία"],
}
# First letter and number of letters that surrogates of a script are drawn from, and the code points that tell it.
SCRIPTS = {"latin": ("a", 26), "cyrillic": ("а", 32), "greek": ("α", 17), "hebrew": ("א", 27), "arabic": ("ب", 19), "devanagari": ("क", 32), "kana": ("か", 40), "hangul": ("가", 2000), "han": ("一", 2000)}
RANGES = [("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("kana", 0x3040, 0x30FF), ("hangul", 0xAC00, 0xD7A3), ("han", 0x3400, 0x9FFF)]


def canonical(kind: str, mention: str) -> str:
    """The form that all mentions of an entity share."""
    if kind in ("phone", "card", "national"):
        return re.sub(r"\D", "", mention)
    if kind == "iban":
        return mention.replace(" ", "")
    if kind == "ip6":
        return mention.lower()
    if kind == "password":
        return re.split(r"[ \t]*[=:][ \t]*", mention, maxsplit=1)[1]
    if kind == "person":
        return mention.split(" ", 1)[1]
    return mention.lower() if kind == "email" else mention


class _Stream:
    """Endless keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.n, self.left = f"{kind}\0{entity}\0{attempt}".encode("utf-8", "surrogatepass"), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.blake2b(self.seed + self.n.to_bytes(4, "little"), key=self.key).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return value % n


def _script(char: str) -> str:
    code = ord(char.lower()[:1])
    return next((name for name, low, high in RANGES if low <= code <= high), "latin")


DIGITS = "0123456789"
_MIXED = "abcdefghijklmnopqrstuvwxyz" + DIGITS
_PAIRS = {'""', "''", "``", "()", "[]", "{}", "<>"}


def _alike(text: str, stream: _Stream, extra: int = 0, more: str = _MIXED) -> str:
    """Each letter becomes one of its case and script, each digit a digit; a leading non-zero digit stays non-zero.

    ``extra`` characters drawn from ``more`` follow the last letter or digit. Text of marks only is drawn whole.
    """
    if text and not any(c.isalpha() or c.isdigit() for c in text):
        left, right = (text[0], text[-1]) if text[0] + text[-1] in _PAIRS and len(text) > 1 else ("", "")
        return left + "".join(more[stream.below(len(more))] for _ in range(max(8, len(text)) + extra)) + right
    out = []
    for i, c in enumerate(text):
        if c.isdigit():
            zero = i == 0 and c != "0"
            out.append(str(1 + stream.below(9)) if zero else str(stream.below(10)))
        elif c.isalpha():
            first, n = SCRIPTS[_script(c)]
            new = chr(ord(first) + stream.below(n))
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    if extra:
        end = 1 + max((i for i, c in enumerate(text) if c.isalpha() or c.isdigit()), default=-1)
        out[end:end] = [more[stream.below(len(more))] for _ in range(extra)]
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def surrogate(kind: str, entity: str, gender: str, key: bytes, attempt: int = 0) -> str:
    """Canonical replacement of a canonical entity."""
    stream = _Stream(key, kind, f"{gender}{entity}", attempt)
    extra = max(0, attempt - 2)
    if kind == "email":
        name, _, domain = entity.partition("@")
        host, _, suffix = domain.rpartition(".")
        return f"{_alike(name, stream, extra)}@{_alike(host, stream)}.{suffix}"
    if kind == "iban":
        body = _alike(entity[4:], stream, extra, DIGITS)
        return f"{entity[:2]}{98 - _mod97(body + entity[:2] + '00'):02d}{body}"
    if kind == "ip6":
        return ":".join("".join("0123456789abcdef"[stream.below(16) if i else 1 + stream.below(15)] for i in range(min(4, len(g) + extra))) if g else "" for g in entity.split(":"))
    if kind == "ip" and extra > 8:
        return "fd" + ":".join(f"{stream.below(256):02x}" if i == 0 else f"{stream.below(65536):x}" for i in range(8))
    if kind == "ip" and extra:
        return ".".join(str(1 + stream.below(254)) for _ in range(4))
    if kind == "ip":
        return ".".join(str(1 + stream.below(9 if len(p) == 1 else 254)) if len(p) < 2 else str((10 + stream.below(90)) if len(p) == 2 else 100 + stream.below(156)) for p in entity.split("."))
    if kind == "card":
        body = entity[0] + _alike(entity[1:-1], stream, extra, DIGITS)
        if _luhn(entity) == 0:
            return body + str((10 - _luhn(body + "0")) % 10)
        return body + str(stream.below(10))
    if kind == "key":
        mark = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", entity)[0]
        return mark + _alike(entity[len(mark) :], stream, extra, _MIXED.upper() if entity.isupper() else _MIXED)
    if kind == "person":
        names = GIVEN.get((gender if gender in ("m", "f") else "mf"[stream.below(2)], _script(entity[0])))
        parts = entity.split(" ")
        given = names[stream.below(len(names))] if names else _alike(parts[0], stream)
        first, n = SCRIPTS[_script(entity[0])]
        letters = "".join(chr(ord(first) + i) for i in range(n))
        last = _alike("x" * (6 + stream.below(3)) if _script(entity[0]) == "latin" else parts[-1].lower(), stream, extra, letters).capitalize()
        return f"{given} {last}" if len(parts) > 1 else last
    if kind == "phone":
        return entity[:1] + _alike(entity[1:], stream, extra, DIGITS)
    return _alike(entity, stream, extra, DIGITS if kind == "national" else _MIXED)


def _found(text: str):
    """Matches of all patterns, looked for only in lines with a trigger or a title."""
    titled = [t for t in (*MALE, *FEMALE) if t in text]
    if not titled and not _TRIGGER.search(text):
        return
    start = 0
    while start <= len(text):
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        if _TRIGGER.search(text, start, end) or any(text.find(t, start, end) >= 0 for t in titled):
            yield from _FIND.finditer(text, start, end)
        start = end + 1


def _checked(text: str, kind: str, start: int, word: str) -> bool:
    """Whether a match of a pattern is an entity: check digits hold, and numbers with dots are no versions or sections."""
    if kind == "card":
        return _luhn(canonical(kind, word)) == 0
    if kind == "iban":
        plain = canonical(kind, word)
        return _mod97(plain[4:] + plain[:4]) == 1
    if kind == "ip6":
        return len([g for g in word.split(":") if g]) > 2 and any(c.isdigit() for c in word)
    return kind != "ip" or not _NO_ADDRESS.search(text, max(0, start - 12), start)


def _unspaced(name: str) -> bool:
    return any(_script(c) in ("han", "kana", "hangul") or "\u0e00" <= c <= "\u0eff" for c in name)


def mentions(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, gender, start, end, canonical form) of every entity mention, left to right."""
    out, persons = [], {}
    for found in _found(text):
        kind, start, end, word, gender = found.lastgroup, found.start(), found.end(), found[0], ""
        if not _checked(text, kind, start, word):
            continue
        entity = canonical(kind, word)
        if kind in ("password", "person"):
            start = end - len(entity)
        if kind == "person":
            title = word.split(" ", 1)[0].rstrip(".")
            gender = "m" if title in MALE else "f" if title in FEMALE else ""
            persons.setdefault(entity, gender)
        out.append((kind, gender, start, end, entity))
    if not persons:
        return out
    # one person for a full name and its family name, in this document
    known = {name: (name, gender) for name, gender in persons.items()}
    for name, gender in persons.items():
        family = name.split(" ")[-1]
        if " " in name and (family not in persons or persons[family] in ("", gender)):
            known[family] = (name, gender)
    taken = sorted((start, end) for _, _, start, end, _ in out)
    out = [(k, known[e][1], a, b, known[e][0]) if k == "person" else (k, g, a, b, e) for k, g, a, b, e in out]
    # scripts without spaces have no word edges; a single letter of another script is too common a word
    whole = [re.escape(n) if _unspaced(n) else rf"(?<!\w){re.escape(n)}(?!\w)" for n in sorted(known, key=len, reverse=True) if len(n) > 1 or n > "\u024f"]
    for found in re.finditer("|".join(whole), text) if whole else ():
        if not any(a < found.end() and found.start() < b for a, b in taken):
            name, gender = known[found[0]]
            out.append(("person", gender, found.start(), found.end(), name))
    return sorted(out, key=lambda m: m[2])


def _fit(kind: str, old: str, new: str) -> str:
    """The canonical surrogate in the shape of a mention: digits go to the places of digits, more digits to the end, case follows."""
    if kind == "person":
        return new if " " in old else new.split(" ")[-1]
    if kind == "iban":
        letters = iter(new)
        return "".join(c if c == " " else next(letters, "") for c in old) + "".join(letters)
    if kind in ("phone", "card", "national"):
        digits = iter(new)
        return "".join(next(digits, "0") if c.isdigit() else c for c in old) + "".join(digits)
    if kind == "email" and old != old.lower():
        return "".join(n.upper() if o.isupper() else n for o, n in zip(old, new)) if len(old) == len(new) else new
    return new


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, gender, entity) of all texts."""

    @task
    def find(batches):
        for batch in batches:
            found = sorted({(k, g, e) for text in batch.column(0).to_pylist() if text for k, g, _, _, e in mentions(text)})
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["kind", "gender", "entity"])

    return docs.select("text").mapInArrow(find, "kind string, gender string, entity string").distinct()


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    def draw(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("kind", "gender", "entity", "attempt")]
            new = [surrogate(k, e, g, key, n) for k, g, e, n in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], [*batch.schema.names, "surrogate"])

    return rows.select("kind", "gender", "entity", "attempt").mapInArrow(draw, "kind string, gender string, entity string, attempt int, surrogate string")


def assign_surrogates(found: DataFrame, key: bytes, most_attempts: int = 50) -> DataFrame:
    """kind, gender, entity, attempt, surrogate: surrogates differ from each other and from every entity of their kind."""
    now = staged(_drawn(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(most_attempts):
        taken = found.select("kind", F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        ranked = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "gender", "entity")).alias("first"), F.count("*").alias("n"))
        clash = ranked.join(taken, ["kind", "surrogate"], "left").where("n > 1 or real")
        bad = now.join(clash, ["kind", "surrogate"]).where(F.col("real").isNotNull() | (F.struct("attempt", "gender", "entity") != F.col("first"))).select("kind", "gender", "entity")
        bad = staged(bad, "clashes")
        if bad.isEmpty():
            return now
        again = now.join(bad, ["kind", "gender", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = staged(now.join(bad, ["kind", "gender", "entity"], "left_anti").union(_drawn(again, key)), "surrogates")
    raise ValueError("too few surrogates for the entities of some kind")


def rewrite(text: str | None, attempts: dict, key: bytes) -> tuple[str | None, int, list[str]]:
    """The text with all entities replaced, their number and kinds."""
    if not text:
        return text, 0, []
    out, at, kinds = [], 0, []
    for kind, gender, start, end, entity in mentions(text):
        new = surrogate(kind, entity, gender, key, attempts.get((kind, gender, entity), 0))
        out += [text[at:start], _fit(kind, text[start:end], new)]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), len(kinds), sorted(set(kinds))


def replace_entities(docs: DataFrame, key: str | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """``docs`` with its text rewritten, plus ``n_entities`` and ``kinds`` (comma-joined); other columns stay."""
    spark = docs.sparkSession
    key = key or spark.conf.get("spark.annoquery.surrogateKey", None) or secrets.token_hex(32)
    secret = hashlib.blake2b(key.encode()).digest()
    found = staged(entities(docs), "entities")
    again = assign_surrogates(found, secret).where("attempt > 0").select("kind", "gender", "entity", "attempt")
    names = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    base = docs.select(*names)
    schema = T.StructType([*base.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.StringType())])
    few = again.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:  # a proven bound: at most `broadcast_rows` short rows reach the driver and the tasks
        known = spark.sparkContext.broadcast({(r["kind"], r["gender"], r["entity"]): r["attempt"] for r in again.collect()})
        source = base
    else:
        known = spark.sparkContext.broadcast({})
        source = _with_attempts(base, again)
    at = names.index("text")

    @task
    def work(batches):
        for batch in batches:
            own = batch.column(len(names)).to_pylist() if not few else [None] * batch.num_rows
            rows = []
            for text, more in zip(batch.column(at).to_pylist(), own):
                attempts = known.value if few else {(m["kind"], m["gender"], m["entity"]): m["attempt"] for m in more or []}
                rows.append(rewrite(text, attempts, secret))
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array([r[0] for r in rows], pa.string())
            columns += [pa.array([r[1] for r in rows], pa.int64()), pa.array([",".join(r[2]) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_entities", "kinds"])

    return source.mapInArrow(work, schema)


def _with_attempts(base: DataFrame, again: DataFrame) -> DataFrame:
    """Documents with the attempts of their own entities, for when there are too many to broadcast."""

    @task
    def find(batches):
        for batch in batches:
            rows = [(h, *x) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in sorted({(k, g, e) for k, g, _, _, e in mentions(t or "")})]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["h", "kind", "gender", "entity"])

    hashed = base.withColumn("h", F.xxhash64("text"))
    mine = hashed.select("h", "text").mapInArrow(find, "h long, kind string, gender string, entity string").distinct().join(again, ["kind", "gender", "entity"])
    lists = mine.groupBy("h").agg(F.collect_list(F.struct("kind", "gender", "entity", "attempt")).alias("attempts"))
    return hashed.join(lists, "h", "left").select(*base.columns, "attempts")
