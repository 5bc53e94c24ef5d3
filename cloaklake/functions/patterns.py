"""Detectors as Column builders: text in, array of hits (start, end, entity_type, score) out; offsets are 0-based code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import cut, cutter, once, scan

HIT = "array<struct<start:int,end:int,entity_type:string,score:double>>"

# White space as the rules below understand it.
WS = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# What the secret types match, in registry order. A type may have several patterns, which are scanned one by one.
SECRETS: dict[str, list[str]] = {
    "OPENSSH_PRIVATE_KEY": [r"-----BEGIN OPENSSH PRIVATE KEY-----[\s\S]*?-----END OPENSSH PRIVATE KEY-----"],
    "PEM_PRIVATE_KEY": [
        r"-----BEGIN RSA PRIVATE KEY-----[\s\S]*?-----END RSA PRIVATE KEY-----",
        r"-----BEGIN PRIVATE KEY-----[\s\S]*?-----END PRIVATE KEY-----",
        r"-----BEGIN ENCRYPTED PRIVATE KEY-----[\s\S]*?-----END ENCRYPTED PRIVATE KEY-----",
    ],
    "API_KEY_SK": [r"sk[-_][a-zA-Z0-9_-]{20,}"],
    "API_KEY_AWS": [r"AKIA[0-9A-Z]{16}"],
    "API_KEY_GITHUB": [r"gh[pousr]_[a-zA-Z0-9]{36,}"],
    "JWT_TOKEN": [r"eyJ[a-zA-Z0-9_-]{20,}\.eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}"],
    "BEARER_TOKEN": [rf"(?i)Bearer[{WS}]+[a-zA-Z0-9._-]{{40,}}"],
    "ENV_PASSWORD": [rf"(?i)[A-Za-z_][A-Za-z0-9_]*(?:PASSWORD|_PWD)[{WS}]*[=:][{WS}]*['\"]?[^{WS}'\"]{{8,}}['\"]?"],
    "ENV_SECRET": [rf"(?i)[A-Za-z_][A-Za-z0-9_]*_SECRET[{WS}]*[=:][{WS}]*['\"]?[^{WS}'\"]{{8,}}['\"]?"],
    "CONNECTION_STRING": [rf"(?i)(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqps?)://[^:]+:[^@{WS}]+@[^{WS}'\"]+"],
}

# A text without its type's clue can't match; the test is far cheaper than the pattern. Patterns are matched, literals looked for.
CLUES: dict[str, tuple[str, bool]] = {
    "OPENSSH_PRIVATE_KEY": ("-----BEGIN OPENSSH", False), "PEM_PRIVATE_KEY": ("PRIVATE KEY-----", False), "API_KEY_SK": ("sk", False),
    "API_KEY_AWS": ("AKIA", False), "API_KEY_GITHUB": ("gh", False), "JWT_TOKEN": ("eyJ", False), "BEARER_TOKEN": ("(?i)bearer", True),
    "ENV_PASSWORD": ("(?i)password|_pwd", True), "ENV_SECRET": ("(?i)_secret", True), "CONNECTION_STRING": ("://", False),
    "EMAIL_ADDRESS": ("@", False), "CREDIT_CARD": ("[0-9]{4}[ -]?[0-9]{4}", True), "IP_ADDRESS": (r"[0-9]\.[0-9]|[0-9A-Fa-f]:", True),
}


def clue(text: Column, entity_type: str) -> Column:
    """Whether the text has its type's clue; true for types without one."""
    if entity_type not in CLUES:
        return F.lit(True)
    sign, pattern = CLUES[entity_type]
    return F.rlike(text, F.lit(sign)) if pattern else F.contains(text, F.lit(sign))


OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
HEXTET = "[0-9A-Fa-f]{1,4}"
PII: dict[str, str] = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "IBAN_CODE": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "CREDIT_CARD": r"(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})",
    "IP_ADDRESS": rf"(?:(?:{OCTET}\.){{3}}{OCTET}|(?:{HEXTET}:){{7}}{HEXTET}|(?:{HEXTET}:){{1,6}}(?::{HEXTET}){{1,6}})",
    "PHONE_NUMBER": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}",
}

#: The same matches, found sooner. An address can begin where a run of its characters does, or where the last match has ended, and a run
#: that no @ follows has none; what isn't followed by a dot or a colon begins no IP address.
SOONER: dict[str, str] = {
    PII["EMAIL_ADDRESS"]: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    PII["IP_ADDRESS"]: rf"(?=[0-9A-Fa-f]{{1,4}}[.:]){PII['IP_ADDRESS']}",
}

#: Documented types that no default registers.
EXTRA: dict[str, str] = {
    "US_SSN": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "CRYPTO": r"(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}",
    "URL": rf"https?://[^{WS}'\"<>]+",
    "MEDICAL_LICENSE": r"[A-Za-z]{2}[0-9]{7}",
    "US_PASSPORT": r"[A-Z][0-9]{8}",
}


def no_hits() -> Column:
    return F.array().cast(HIT)


PART = "array<struct<gap:int,len:int,entity_type:string,score:double>>"


def find_each(text: Column, wanted: list[tuple[str, str, float]], clues: list[Column] | None = None) -> Column:
    """All non-overlapping matches, left to right, of each of the patterns (pattern, entity_type, score), one after the other.

    Offsets come from the lengths of matches and of what is between; what follows a pattern's last match sets the sum back to 0.
    clues: conditions under which the patterns are searched for.
    """
    if not wanted:
        return no_hits()

    def parts(pattern: str, entity_type: str, score: float) -> Column:
        pattern = SOONER.get(pattern, pattern)
        part = lambda g, x: F.struct(F.length(g).alias("gap"), F.length(x).alias("len"), F.lit(entity_type).alias("entity_type"), F.lit(score).alias("score"))
        some = lambda found: F.when(F.size(found) > 0, F.zip_with(F.split(text, pattern, -1), found, part)).otherwise(F.array().cast(PART))
        return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)

    every = [parts(*w) for w in wanted]
    if clues:
        every = [F.when(c, p).otherwise(F.array().cast(PART)) for c, p in zip(clues, every, strict=True)]
    hit = lambda pos, x: F.struct((pos + x.gap).alias("start"), (pos + x.gap + x.len).alias("end"), x.entity_type.alias("entity_type"), x.score.alias("score"))
    state_of = lambda pos, x: F.coalesce(pos + x.gap + x.len, F.lit(0))
    out_of = lambda pos, x: F.when(x.len.isNull(), no_hits()).otherwise(F.array(hit(pos, x)))
    return scan(F.concat(*every) if len(every) > 1 else every[0], F.lit(0), state_of, out_of, HIT).out


def find_all(text: Column, pattern: str, entity_type: str, score: float = 1.0) -> Column:
    """All non-overlapping matches of a pattern, left to right."""
    return find_each(text, [(pattern, entity_type, score)])


def value_of(text: Column, hit: Column) -> Column:
    return F.substring(text, hit.start + 1, hit.end - hit.start)


def apart(c: Column, hit: Column) -> Column:
    """Neither a letter nor a digit touches the hit. c: cutter(text)."""
    before = cut(c, F.greatest(F.lit(0), hit.start - 1), F.least(F.lit(1), hit.start))
    return ~F.rlike(before, F.lit("[0-9A-Za-z]")) & ~F.rlike(cut(c, hit.end, F.lit(1)), F.lit("[0-9A-Za-z]"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    return once(digits(value), lambda d: (F.length(d) >= 13) & (F.length(d) <= 19) & F.call_function("luhn_check", d))


def iban_ok(value: Column) -> Column:
    """ISO 7064 mod 97: the first four characters go last, letters become 10 to 35, the number leaves 1."""
    number = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = lambda moved: F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(F.ascii(c) >= 65, 100).otherwise(10) + number(c)) % 97))
    return once(F.replace(value, F.lit(" "), F.lit("")), lambda flat: (F.length(flat) >= 15) & (F.length(flat) <= 34) & (rest(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))) == 1))


def with_cutter(text: Column, hits: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(cutter of the text, hits) where there are hits, both worked out once."""
    return once(hits, lambda hs: F.when(F.size(hs) > 0, once(cutter(text), lambda c: use(c, hs))).otherwise(hs))


def cut_hit(c: Column, hit: Column) -> Column:
    return cut(c, hit.start, hit.end - hit.start)


def secret_hits(text: Column, entity_types: list[str]) -> Column:
    """Hits of secret types, in their order. A text without a type's clue is not searched for it."""

    wanted = [(p, t, 1.0) for t in entity_types for p in SECRETS[t]]
    return find_each(text, wanted, [clue(text, t) for _, t, _ in wanted])


def pii_hits(text: Column, entity_types: list[str], language: Column | None = None, contexts: dict[str, list[str]] | None = None) -> Column:
    """Hits of recognisers, in their order. A phone number scores 0.4, or 0.75 where a context word of its language is among the 50 characters before."""
    found = find_each(text, [(PII.get(t) or EXTRA[t], t, 0.4 if t == "PHONE_NUMBER" else 1.0) for t in entity_types], [clue(text, t) for t in entity_types])
    sound = {
        "IBAN_CODE": lambda c, h: iban_ok(cut_hit(c, h)),
        "CREDIT_CARD": lambda c, h: luhn_ok(cut_hit(c, h)),
        "IP_ADDRESS": lambda c, h: F.lit(True),
        "PHONE_NUMBER": lambda c, h: F.length(digits(cut_hit(c, h))).between(7, 15),
    }
    checked = [t for t in entity_types if t in sound]
    if not checked:
        return found

    def kept(c: Column, h: Column) -> Column:
        out = F.when(~h.entity_type.isin(checked), True).when(~apart(c, h), False)
        for t in checked:
            out = out.when(h.entity_type == t, sound[t](c, h))
        return out

    if "PHONE_NUMBER" not in checked or not contexts:
        return with_cutter(text, found, lambda c, hs: F.filter(hs, lambda h: kept(c, h)))
    if len(contexts) == 1 and language is None:
        words = F.lit(next(iter(contexts.values())))
    else:
        table = F.create_map(*[x for k, v in contexts.items() for x in (F.lit(k), F.lit(v))])
        words = F.coalesce(F.element_at(table, language if language is not None else F.lit("en")), F.array().cast("array<string>"))
    before = lambda c, h: F.lower(cut(c, F.greatest(F.lit(0), h.start - 50), F.least(F.lit(50), h.start)))
    near = lambda c, h, ws: once(before(c, h), lambda b: F.exists(ws, lambda w: F.contains(b, F.lower(w))))
    score = lambda c, h, ws: F.when(h.entity_type != "PHONE_NUMBER", h.score).when(near(c, h, ws), 0.75).otherwise(h.score)
    scored = lambda c, h, ws: F.struct(h.start.alias("start"), h.end.alias("end"), h.entity_type.alias("entity_type"), score(c, h, ws).alias("score"))
    return with_cutter(text, found, lambda c, hs: once(words, lambda ws: F.transform(F.filter(hs, lambda h: kept(c, h)), lambda h: scored(c, h, ws))))


def apart_only(text: Column, hits: Column) -> Column:
    """The hits that neither a letter nor a digit touches."""
    return with_cutter(text, hits, lambda c, hs: F.filter(hs, lambda h: apart(c, h)))


def gazetteer_hits(text: Column, names: list[str], entity_type: str, score: float = 0.85) -> Column:
    """Hits of listed names (for PERSON or LOCATION, where no model is plugged in), longest names first."""
    quoted = "|".join(rf"\Q{n}\E" for n in sorted(names, key=lambda n: (-len(n), n)))
    return apart_only(text, find_all(text, quoted, entity_type, score)) if names else no_hits()


#: Words for nationalities, religions and political groups.
NRP = [
    "American", "Arab", "Australian", "Austrian", "Belgian", "Brazilian", "British", "Buddhist", "Canadian", "Catholic", "Chinese", "Christian", "Danish", "Dutch", "Finnish", "French", "German", "Greek",
    "Hindu", "Indian", "Irish", "Italian", "Japanese", "Jewish", "Korean", "Mexican", "Muslim", "Norwegian", "Polish", "Portuguese", "Protestant", "Russian", "Spanish", "Swedish", "Swiss", "Turkish", "Ukrainian",
]

#: Detectors by type: text to hits. Further detectors may be registered; those that come with the engine are searched for together.
REGISTRY: dict[str, Callable[[Column], Column]] = {t: (lambda text, t=t: secret_hits(text, [t])) for t in SECRETS} | {t: (lambda text, t=t: pii_hits(text, [t])) for t in (*PII, *EXTRA)}
_OWN = dict(REGISTRY)
REGISTRY["NRP"] = lambda text: gazetteer_hits(text, NRP, "NRP")


def register(entity_type: str, build: Callable[[Column], Column]) -> None:
    REGISTRY[entity_type] = build


def detect(text: Column, types: list[str], max_chars: int = 0, language: Column | None = None, contexts: dict[str, list[str]] | None = None) -> Column:
    """Hits of all given types, secrets in registry order, then personal data, then registered types; only the first max_chars
    characters are scanned (0: all)."""
    scanned = F.substring(text, 1, max_chars) if max_chars else text
    own = [t for t in REGISTRY if t in types and REGISTRY[t] is _OWN.get(t)]
    secrets, personal = [t for t in own if t in SECRETS], [t for t in own if t not in SECRETS]
    built = [secret_hits(scanned, secrets)] if secrets else []
    built += [pii_hits(scanned, personal, language, contexts)] if personal else []
    built += [REGISTRY[t](scanned) for t in REGISTRY if t in types and t not in own]
    return F.concat(*built) if built else no_hits()
