"""PII surrogates: keyed, type-consistent replacements.

Detected entities are replaced by a keyed permutation of their own format:
every character class of a template (digits, letters of either case, by
script) is one digit of a mixed-radix number, and a Feistel network with
cycle walking permutes the numbers of that template. Letters outside the three
alphabets form classes with the letters of their kind in the same stretch of
code points. The map is one to one, so different entities stay different, equal
ones stay equal everywhere, and shape, script, issuer, country, top-level domain
and check digits survive. Digits of any script count by their value and are
written back in their own script.

A person's name is a list of parts. The surname maps by itself, whatever title
or given name stands with it, so "Dr. Weber" and "Frau Weber" stay one family;
given names map to given names of the same script and gender.

Collision checks run in Spark over the distinct entities (parts of names
each for itself) of the whole corpus: where two would share a surrogate, or a
surrogate is an entity that occurs itself, all but the smallest move to their
next candidate until none collide; it is an error if that does not end. Only
those exceptions are joined back to documents.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.shared import materialise

KEY = b"quadrille-surrogates"
MAX_ROUNDS, SALTS = 60, 8
TYPES = ("email", "phone", "card", "ip", "iban", "ssn", "name")

# Choices of this library: name lists by script and gender, and titles that tell a gender.
GIVEN = {
    ("latin", "f"): "Alma Bettina Carla Dora Elena Flora Greta Helga Irma Julia Karla Linda Marta Nora Olga Paula Rosa Silvia Tilda Vera".split(),
    ("latin", "m"): "Albert Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul Robert Simon Tobias Victor".split(),
    ("latin", "n"): "Alex Bente Chris Dominique Eike Francis Glenn Jamie Kim Lee Maxime Noel Pat Robin Sasha Toni".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга Полина Софья Тамара Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура Слава".split(),
    ("greek", "f"): "Άννα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Μάριος Νίκος Πέτρος Στέφανος".split(),
    ("greek", "n"): "Άρης Φώτης".split(),
}
SURNAMES = {
    "latin": "Adler Barton Castel Duval Ekman Ferrer Graf Holm Ibarra Jansen Keller Lindt Moreau Navarro Ortega Pichler Quint Rossi Sander Torres Ulrich Vogel Weber Xaver Young Zeller".split(),
    "cyrillic": "Белых Гончар Дорош Живаго Зинчук Коваль Лозенко Мороз Оленич Сухих Ткач Черных".split(),
    "greek": "Αλεξίου Βλάχου Γεωργίου Δήμου Ιωάννου Κώστα Λάμπρου Νικολάου Παύλου Σταύρου".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mx": "n", "Dr": "n", "Prof": "n", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Srta": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}

LOCAL_MARKS = "._+%-"
AT_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24}(?!\w)")
DIGITS = re.compile(r"(?<![\w.])\+?\(?\d[\d ().\-/]{5,}\d(?![\w])")
IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}\Z")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}\Z")
CARD = re.compile(r"\d{13,19}\Z|\d{4}(?:[ -]\d{4}){3}\Z|\d{4}[ -]\d{6}[ -]\d{5}\Z")
PHONE = re.compile(r"\+\d{1,3}[ .\-/(]{0,2}\(?\d{1,4}\)?(?:[ .\-/]{0,2}\d{2,5}){1,4}\Z|\(?\d{3}\)?[ .\-/]\d{3}[ .\-]\d{4}\Z")
# The same forms inside a longer run, where they do not go on over a separator.
INNER_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
INNER_SSN = re.compile(r"(?<![\d.\-])\d{3}-\d{2}-\d{4}(?![.\-]?\d)")
INNER_CARD = re.compile(r"(?<![\d.\-+])(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![.\-]?\d)")
FOUR_BEFORE, FOUR_AFTER = re.compile(r"(?<!\d)\d{4}[ -]\Z"), re.compile(r"[ -]\d{4}(?!\d)")
INNER_PHONE = re.compile(r"(?<![\d.\-])(?:\(\d{3}\)[ .\-/]?|\d{3}[ .\-/])\d{3}[ .\-]\d{4}(?![.\-]?\d)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
TITLE = re.compile(r"(?<!\w)(%s)(?!\w)\.?[ ]+" % "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)))
NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")
MAX_NAME_WORDS = 3

LOWER = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
ALPHABETS = [("0123456789"), *LOWER.values(), *(x.upper() for x in LOWER.values())]
CLASS_OF = {c: a for a in ALPHABETS for c in a}
BEYOND = 256  # code points that share classes outside of the alphabets


@lru_cache(maxsize=4096)
def alphabet(c: str) -> str:
    """The characters that may stand for ``c``, itself included; none for marks and separators."""
    if c in CLASS_OF:
        return CLASS_OF[c]
    if c.isdecimal():
        return "".join(chr(ord(c) - unicodedata.decimal(c) + i) for i in range(10))
    if not c.isalnum():
        return ""
    start, kind = ord(c) // BEYOND * BEYOND, (unicodedata.category(c), c.lower() == c)
    return "".join(x for x in map(chr, range(start, start + BEYOND)) if x not in CLASS_OF and (unicodedata.category(x), x.lower() == x) == kind and x.isalnum() and len(x.lower()) == 1 and len(x.upper()) == 1) if len(c.lower()) == len(c.upper()) == 1 else c


def ascii_digits(text: str) -> str:
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def digit_like(digit: str, c: str) -> str:
    """An ASCII digit in the script of the digit ``c``."""
    return digit if c.isascii() or not c.isdecimal() or not digit.isdecimal() else chr(ord(c) - unicodedata.decimal(c) + int(digit))


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(n if i % 2 else (2 * n - 9 if n > 4 else 2 * n) for i, n in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def script_of(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin"


def _feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it lands inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(8):
            f = int.from_bytes(hmac.digest(key, f"{tweak}|{size}|{r}|{right}".encode(), "sha256"), "big")
            left, right = right, left ^ f & mask
        value = left << half | right
        if value < size:
            return value


def permute(text: str, key: bytes, tweak: str, valid=None) -> str:
    """``text`` with its class characters permuted within their template; others stay.

    With ``valid`` the permutation of valid texts is walked until the result is
    valid, which stays one to one on them.
    """
    places = [(i, a) for i, c in enumerate(text) if (a := alphabet(c))]
    size = 1
    for _, a in places:
        size *= len(a)
    if size == 1:
        return text
    if valid and not valid(text):
        valid = None  # the walk comes back to a valid start, and need not end from another
    template = tweak + "|" + "".join(min(a) if (a := alphabet(c)) else c for c in text)
    while True:
        value = 0
        for i, a in places:
            value = value * len(a) + a.index(text[i])
        value, out = _feistel(value, size, key, template), list(text)
        for i, a in reversed(places):
            value, at = divmod(value, len(a))
            out[i] = a[at]
        text = "".join(out)
        if valid is None or valid(text):
            return text


def _public_ip(text: str) -> bool:
    parts = text.split(".")
    n = [int(p) for p in parts]
    return all(x < 256 and str(x) == p for x, p in zip(n, parts, strict=True)) and 0 < n[0] < 224 and n[0] not in (10, 127)


def surrogate(entity: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The replacement of a canonical entity ``type|gender|value`` (of a name: of one part)."""
    kind, gender, value = entity.split("|", 2)
    tweak = f"{kind}.{attempt}"
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        return ".".join([permute(local, key, tweak) + "@" + ".".join(permute(x, key, "domain") if x != "example" else x for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        out = _octets(value, key, tweak)
        while not _public_ip(out):
            out = _octets(out, key, tweak)
        return out
    if kind == "card":
        body = value[0] + permute(value[1:-1], key, tweak + value[0])
        return body + str((luhn_digit(body) + int(value[-1]) - luhn_digit(value[:-1])) % 10)
    if kind == "phone":
        head, national = value.split(" ", 1)
        nanp = head in ("+1", "-") and len(national) == 10
        shape = (lambda x: x[0] > "1" and x[3] > "1") if nanp and national[0] > "1" and national[3] > "1" else (lambda x: (x[0] == "0") == (national[0] == "0"))
        return f"{head} {permute(national, key, tweak + head, shape)}"
    if kind == "ssn":
        return permute(value, key, tweak, (lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000") if value[0] != "9" else None)
    if kind == "iban":
        rest = permute(value[4:], key, tweak + value[:2])
        return value[:2] + _iban_check(value[:2], rest) + rest
    return _name(kind, value, gender, attempt, key)


def parts_of(entity: str) -> list[str]:
    """What maps by itself: the given names and the surname of a name, else the entity."""
    if not entity.startswith("name|"):
        return [entity]
    _, gender, value = entity.split("|", 2)
    words = value.split(" ")
    return [*(f"given|{gender}|{w}" for w in words[:-1]), f"family||{words[-1]}"]


def replacement(entity: str, attempts: dict[str, int], key: bytes = KEY) -> str:
    return " ".join(surrogate(x, attempts.get(x, 0), key) for x in parts_of(entity))


def _octets(value: str, key: bytes, tweak: str) -> str:
    number = 0
    for p in value.split("."):
        number = number * 256 + int(p)
    number = _feistel(number, 1 << 32, key, tweak)
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))


def _name(kind: str, value: str, gender: str, attempt: int, key: bytes) -> str:
    script = script_of(value)
    pool = SURNAMES[script] if kind == "family" else GIVEN[script, gender]
    pick = lambda what: pool[int.from_bytes(hmac.digest(key, f"{kind}|{script}|{gender}|{value}|{what}".encode(), "sha256")[:8], "big") % len(pool)]
    # A used-up list goes on with double names, so candidates outgrow any corpus.
    return "-".join([pick(attempt), *(pick(f"{attempt}.{extra}") for extra in range(attempt // 2))])


def gender_of(titled: str, given: str) -> str:
    """The title's gender, or for a neutral title what the given name tells."""
    if titled != "n" or not given:
        return titled
    known = {g for (_, g), names in GIVEN.items() if given in (x.lower() for x in names)} - {"n"}
    return known.pop() if len(known) == 1 else "f" if given[-1] in "aаяα" else "n"


def _number(raw: str) -> str | None:
    """The canonical entity that a run of digits and separators is as a whole."""
    raw = ascii_digits(raw)
    digits = re.sub(r"\D", "", raw)
    if IP.match(raw) and all(int(p) < 256 and str(int(p)) == p for p in raw.split(".")):
        return f"ip||{raw}"
    if SSN.match(raw):
        return f"ssn||{digits}"
    if CARD.match(raw):
        return f"card||{digits}"
    if 8 <= len(digits) <= 15 and PHONE.match(raw):
        code = re.match(r"\+(1(?=\D)|\d{1,3}(?=\D)|\d{1,2})", raw)
        head = "+" + code[1] if code else "-"
        return f"phone||{head} {digits[len(code[1]) if code else 0:]}"
    return None


def numbers(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """The entities in a run: the run itself, else what stands side by side in it.

    Addresses, social security numbers and cards have the stricter forms and go
    first. Among more groups of four digits only the Luhn check tells which
    of them are a card. Phones are sought in what lies between.
    """
    whole = _number(text[start:end])
    if whole:
        return [(start, end, whole)]
    out: list[tuple[int, int, str]] = []
    run = text[start:end]
    for pattern in (INNER_IP, INNER_SSN, INNER_CARD):
        at = 0
        while m := pattern.search(run, at):
            (a, b), x = m.span(), _number(m[0])
            among = x and x.startswith("card") and (FOUR_BEFORE.search(run, max(0, a - 6), a) or FOUR_AFTER.match(run, b))
            good = x and not (among and luhn_digit(x[6:-1]) != int(x[-1]))
            at = b if good else a + 1
            if good:
                out.append((start + a, start + b, x))
    at, phones = start, []
    for a, b, _ in [*sorted(out), (end, end, "")]:
        gap = re.search(r"[+(]?\(?\d(?:.*\d)?", text[at:a])
        if gap:
            s, e = at + gap.start(), at + gap.end()
            x = _number(text[s:e]) if out else None
            phones += [(s, e, x)] if x else _phones(text, s, e)
        at = b
    return out + phones


def _phones(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Phones in a stretch that is none as a whole: an international one at its start, national ones anywhere."""
    if text[start] == "+":
        fits = [(m.end(), x) for m in re.finditer(r"\d(?!\d)", text[start : min(end, start + 48)]) if (x := _number(text[start : start + m.end()])) and x.startswith("phone")]
        if fits:
            # North American numbers have a fixed length; else the longest, unless a shorter one leaves another entity.
            n, x = next((f for f in fits if f[1].startswith("phone||+1 ") and len(f[1]) == 20), fits[-1])
            rest = numbers(text, start + n, end) if n < end - start else []
            for m, y in reversed(fits[:-1]) if n == fits[-1][0] else ():
                tail = re.search(r"\(?\d.*", text[start + m : end])
                if len(tail[0]) >= 7 and (more := numbers(text, start + m + tail.start(), end)) and len(more) > len(rest):
                    n, x, rest = m, y, more
            if n < end - start and (tail := re.search(r"\(?\d.*", text[start + n : end])):
                rest = numbers(text, start + n + tail.start(), end)
            return [(start, start + n, x), *rest]
    run = text[start:end]
    spaced = re.fullmatch(r"\d{3} \d{3} \d{4}(?: \d{3} \d{3} \d{4})+", run)
    # Numbers between spaces alone are a phone only where the whole stretch is.
    return [(start + m.start(), start + m.end(), x) for m in INNER_PHONE.finditer(run) if (spaced or re.search(r"[().\-/]", m[0])) and (x := _number(m[0]))]


def _names(text: str) -> list[tuple[int, int, str]]:
    """Names after titles: up to ``MAX_NAME_WORDS`` capitalised words that are no titles themselves."""
    out = []
    for m in TITLE.finditer(text):
        at, end, words = m.end(), m.end(), []
        while len(words) < MAX_NAME_WORDS and (w := NAME_WORD.match(text, at)) and w[0][0].isupper() and w[0] not in TITLES:
            words.append(w[0].lower())
            at = end = w.end()
            while at < len(text) and text[at] == " ":
                at += 1
            if at == end:
                break
        if words:
            before = TITLE.search(text, max(0, m.start() - 16), m.start())  # "Frau Dr. Weber"
            title = TITLES[before[1]] if TITLES[m[1]] == "n" and before and before.end() == m.start() else TITLES[m[1]]
            out.append((m.end(), end, f"name|{gender_of(title, words[0] if len(words) > 1 else '')}|{' '.join(words)}"))
    return out


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, canonical entity) of every mention, leftmost first, without overlaps."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        domain, start = AT_DOMAIN.match(text, at + 1), at
        while domain and start and (text[start - 1].isalnum() or text[start - 1] in LOCAL_MARKS):
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        if domain and start < at and text[at - 1] != ".":
            local = text[start:at]
            found.append((start, domain.end(), f"email||{local.lower() if len(local.lower()) == len(local) else local}@{domain[0].lower()}"))
        at = text.find("@", at + 1)
    for m in DIGITS.finditer(text):
        found += numbers(text, *m.span())
    if any(t in text for t in TITLES):
        found += _names(text)
    for m in IBAN.finditer(text) if re.search(r"[A-Z]{2}\d{2}", text) else ():
        flat = ascii_digits(m[0].replace(" ", ""))
        if 15 <= len(flat) <= 34 and _iban_check(flat[:2], flat[4:]) == flat[2:4]:
            found.append((m.start(), m.end(), f"iban||{flat}"))
    out, end = [], 0
    for s, e, x in sorted(found, key=lambda f: (f[0], -f[1])):
        if s >= end:
            out.append((s, e, x))
            end = e
    return out


def shaped(mention: str, entity: str, new: str) -> str:
    """The surrogate written the way the mention is: its separators, spaces, digits and case stay."""
    kind = entity.split("|", 1)[0]
    if kind == "email":
        at = new.rindex("@")
        return "".join(n.upper() if m.isupper() and len(n.upper()) == 1 else n for n, m in zip(new[:at], mention, strict=False)) + new[at:]
    if kind == "ip":
        return "".join(digit_like(c, mention[0]) for c in new)
    if kind == "name":
        words = iter(new.split(" "))
        return "".join(p if p.isspace() else w.upper() if (w := next(words)) and p.isupper() and len(p) > 1 else w for p in re.findall(r" +|[^ ]+", mention))
    left = iter(new.removeprefix("-").replace(" ", "").removeprefix("+"))
    return "".join(digit_like(next(left), c) if c.isalnum() else c for c in mention)


def _entities(batches):
    for batch in batches:
        seen = sorted({p for t in batch["text"] if t for _, _, x in detect(t) for p in parts_of(x)})
        if seen:
            yield pd.DataFrame({"entity": seen})


def _candidates(key: bytes):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            new = [surrogate(x, int(n), key) for x, n in zip(batch["entity"], batch["attempt"], strict=True)]
            yield batch.assign(slot=[f"{x.split('|', 1)[0]}|{n.lower()}" for x, n in zip(batch["entity"], new, strict=True)])

    return run


def resolve(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(entity, attempt) of the entities that cannot have their first candidate."""
    slot_of = F.concat(F.substring_index("entity", "|", 1), F.lit("|"), F.lower(F.expr("substring(entity, char_length(substring_index(entity, '|', 2)) + 2)")))
    own = materialise(entities.select("entity", slot_of.alias("own")))
    schema = "entity string, attempt int, slot string"
    placed = materialise(own.select("entity", F.lit(0).alias("attempt")).mapInPandas(_candidates(key), schema))
    for _ in range(MAX_ROUNDS):
        first = placed.groupBy("slot").agg(F.min(F.struct("attempt", "entity"))["entity"].alias("first"), F.count(F.lit(1)).alias("n"))
        shared = placed.join(first.where("n > 1"), "slot").where("entity <> first").select("entity")
        real = placed.join(own.select(F.col("own").alias("slot")).distinct(), "slot", "left_semi").select("entity")
        bad = materialise(shared.unionByName(real).distinct())
        if bad.isEmpty():
            return placed.where("attempt > 0").select("entity", "attempt")
        moved = placed.join(bad, "entity").select("entity", (F.col("attempt") + 1).alias("attempt")).mapInPandas(_candidates(key), schema)
        placed = materialise(placed.join(bad, "entity", "left_anti").unionByName(moved))
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def mentions(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({p for _, _, x in detect(t) for p in parts_of(x)}) if t else [] for t in texts], dtype=object)


def _rewriter(key: bytes):
    @F.pandas_udf("struct<text:string,n_entities:long,spans:string>")
    def rewrite(texts: pd.Series, moved: pd.Series) -> pd.DataFrame:
        rows, held = [], {}
        for text, m in zip(texts, moved, strict=True):
            text = text or ""
            attempts = {x["entity"]: int(x["attempt"]) for x in m} if m is not None and len(m) else {}
            found, parts, at = detect(text), [], 0
            for s, e, x in found:
                mark = (x, *(attempts.get(p, 0) for p in parts_of(x))) if attempts else x
                if mark not in held:
                    held[mark] = replacement(x, attempts, key)
                parts += [text[at:s], shaped(text[s:e], x, held[mark])]
                at = e
            rows.append(("".join(parts) + text[at:], len(found), ",".join(f"{x.split('|', 1)[0]}:{s}:{e}" for s, e, x in found)))
        return pd.DataFrame(rows, columns=["text", "n_entities", "spans"])

    return rewrite


def replace_pii(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``row`` (struct of ``carry``), ``text`` with surrogates, ``n_entities``, ``spans`` (type:start:end).

    Null text counts as empty; a text without entities comes back as it is;
    repeated rows stay and get equal surrogates; an empty table gives no rows.
    Entities are told apart over the whole table, whatever row holds them.
    """
    distinct = materialise(docs.select(F.col(text_col).alias("text")).mapInPandas(_entities, "entity string").distinct())
    moved = materialise(resolve(distinct, key))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"), F.col(text_col).alias("_text"))
    none = F.lit(None).cast("array<struct<entity:string,attempt:int>>")
    if moved.isEmpty():
        out = row.withColumn("_moved", none)
    else:
        # Only texts that mention an exception meet the table of exceptions.
        hits = row.select(F.xxhash64("_text").alias("_h"), F.explode(F.pandas_udf(mentions, "array<string>")("_text")).alias("entity")).distinct().join(moved, "entity")
        per = hits.groupBy("_h").agg(F.collect_list(F.struct("entity", "attempt")).alias("_moved"))
        # A text that many rows share meets its exceptions in several tasks.
        salted = materialise(per).withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        out = row.withColumn("_h", F.xxhash64("_text")).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(salted, ["_h", "_salt"], "left")
    return out.select("row", _rewriter(key)("_text", "_moved").alias("s")).select("row", "s.text", "s.n_entities", "s.spans")
