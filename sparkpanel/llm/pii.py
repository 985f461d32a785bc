"""Personal data by patterns, checksums and context, in DataFrame functions alone (operator 9).

A regular expression proposes spans of each kind.  ``split`` by the same
expression gives the gaps between the matches, so a running sum of lengths
gives every offset without a Python pass, and the gaps hold each match's neighbourhood.  Validators confirm spans: parts of
an address, Luhn's digit sum for cards, the remainder modulo 97 for account
numbers (IBAN: as long as their country has them, or any of 15 to 34 signs), digit counts for phones.  A span's score starts from its kind,
rises with a valid checksum and with words of its kind within ``CONTEXT`` code
points (as far as the next match of the kind), and falls where words of harmless numbers stand there.  Base kinds
(email, ip, card, phone) always stay; added kinds stay from ``THRESHOLD`` up.

The expressions are the plain ones with possessive quantifiers and a look at
the sign before, which start no match inside a run: same matches, but linear
time and no recursion on very long runs.

Offsets are code points, end exclusive.  Null, empty and blank texts have no
spans and the SHA-256 of the empty string; null doc_ids are kept; a very long text is one
row's work.  Matches of a kind don't overlap, so starts have no ties; spans
of different kinds may.  Repeated rows get equal rows.  An empty table gives no
rows.  Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

CONTEXT = 40
THRESHOLD = 0.5

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = (*BASE, *ADDED)

_LOCAL = "[A-Za-z0-9._%+-]"
#: Signs of an account number by the country it begins with (the IBAN registry and the countries that use its form).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU"}
_HEAD = "[A-Z]{2}[0-9]{2}"
_END = "(?![A-Za-z0-9])"
_EXACT = "|".join(rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())
#: Forms of an account number, tried in this order: its country's length, one run of signs, runs with single spaces.
_FORMS = (rf"(?:{_EXACT}){_END}", rf"{_HEAD}[A-Z0-9]{{11,30}}{_END}", rf"{_HEAD}(?:\x20?[A-Z0-9]){{11,30}}{_END}")
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # consumes its first four signs only: a number that begins within a wrong one is proposed too
    "iban": rf"(?<![A-Za-z0-9])(?={_HEAD})" + "".join(f"(?=({form})?)" for form in _FORMS) + _HEAD,
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What every match of a kind holds: texts without it are not searched.
_HOLDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
          "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"-[0-9]{2}-"}

#: Score of a kind before and after its validator, words that raise and words that lower it.
SCORES = {"email": (0.9, 0.9), "ip": (0.2, 0.6), "card": (0.1, 0.8), "phone": (0.3, 0.7), "iban": (0.1, 0.8),
          "ssn": (0.1, 0.45)}
RAISE = {"email": "mail|contact|write", "ip": "ip|address|host|server|client", "card": "card|visa|master|amex|credit|debit|pay",
         "phone": "phone|call|tel|mobile|fax|contact", "iban": "iban|account|bank|transfer", "ssn": "ssn|social|security|tax"}
LOWER = "version|release|order|invoice|serial|isbn|part"
UP, DOWN = 0.15, 0.2


MATCHES = "array<struct<start:bigint,match:string,before:string,after:string>>"


def located(pairs: Column) -> Column:
    """Matches with their starts: a running sum over (gap, used, match, before, after).

    An ``aggregate`` copies the array that it extends, so it runs over blocks of about the square root of
    the matches, each made by an inner one: a text full of matches costs n^1.5 copies instead of n^2.
    """
    none = F.array().cast(MATCHES)
    block = F.greatest(F.ceil(F.sqrt(F.size(pairs))), F.lit(1)).cast("int")

    def state(at: Column, out: Column) -> Column:
        return F.struct(at.cast("long").alias("at"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        found = F.struct(here.alias("start"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
        return state(here + x["used"], F.concat(acc["out"], F.array(found)))

    def join(acc: Column, b: Column) -> Column:
        own = F.aggregate(F.slice(pairs, b * block + 1, block), state(acc["at"], none), step)
        return F.transform(F.array(own), lambda x: state(x["at"], F.concat(acc["out"], x["out"])))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / block).cast("int"))
    return F.when(F.size(pairs) > 0, F.aggregate(blocks, state(F.lit(0), none), join, lambda acc: acc["out"])).otherwise(none)


def chosen(text: Column, kind: str) -> Column:
    """The matches of a kind's pattern; of an account number's forms the first with remainder 1."""
    pattern = F.lit(PATTERNS[kind])
    if kind != "iban":
        return F.regexp_extract_all(text, pattern, F.lit(0))
    forms = [F.regexp_extract_all(text, pattern, F.lit(i)) for i in range(1, len(_FORMS) + 1)]
    names = [f"m{i}" for i in range(len(forms))]

    def pick(x: Column) -> Column:
        first = F.when(mod97(x["m0"]) == 1, x["m0"])
        for n in names[1:]:
            first = first.when(mod97(x[n]) == 1, x[n])
        return first.otherwise(F.lit(""))

    return F.transform(F.arrays_zip(*[f.alias(n) for f, n in zip(forms, names)]), pick)


def proposals(rows: DataFrame) -> DataFrame:
    """``<kind>_pairs``: each match with the gap before it and its neighbourhood, of texts that hold one.

    The context is what stands between a match and its neighbours of the same kind, at most CONTEXT code
    points a side, cut from the gaps, so no match looks through the text again."""
    parts = rows.select("doc_id", *[F.when(F.col("text").rlike(_HOLDS[k]), chosen(F.col("text"), k)).alias(f"{k}_found") for k in KINDS],
                        *[F.when(F.col("text").rlike(_HOLDS[k]), F.split("text", PATTERNS[k], -1)).alias(f"{k}_gaps") for k in KINDS])

    def pairs(k: str) -> Column:
        found, gaps = F.col(f"{k}_found"), F.col(f"{k}_gaps")
        own = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.greatest(F.size(found), F.lit(0))).alias("next"),
                           found.alias("match"))

        def one(x: Column) -> Column:
            length = F.length(x["match"])
            used = F.lit(4) if k == "iban" else length  # of an account number the head only
            return F.struct(F.length(x["gap"]).cast("long").alias("gap"), used.cast("long").alias("used"), x["match"].alias("match"),
                            F.right(x["gap"], F.lit(CONTEXT)).alias("before"),
                            F.substr(x["next"], F.greatest(length - used, F.lit(0)) + 1, F.lit(CONTEXT)).alias("after"))

        some = F.exists(found, lambda m: plausible(m, k) & (F.length(m) > 0))
        return F.when(some, F.transform(own, one)).alias(f"{k}_pairs")

    return parts.select("doc_id", *[pairs(k) for k in KINDS])


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def plausible(match: Column, kind: str) -> Column:
    """Whether a match meets its kind's conditions on parts and digit counts."""
    if kind == "ip":
        # leading zeros don't make a part larger
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
                        .rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(match)).between(13, 19) & (luhn(digits(match)) == 0)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def luhn(number: Column) -> Column:
    """Luhn's digit sum modulo 10 (0: valid) of a string of digits."""
    backwards = F.split(F.reverse(number), "")
    return F.aggregate(F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                                   .otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
                       F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10


def mod97(account: Column) -> Column:
    """An account number's remainder modulo 97 (1: valid): first four signs last, A is 10."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.expr("substring('', 1, 0)"), F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0).cast("long"), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("long")) % 97).when(
        c.rlike("[A-Z]"), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a))


def confirmed(match: Column, kind: str) -> Column:
    """Whether the kind's checksum or form holds."""
    if kind == "iban":
        return mod97(match) == 1
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)") & ~match.rlike("-00-") & ~match.rlike("0000$")
    return plausible(match, kind)


def scored(kind: str) -> Column:
    """Array of (kind, start, end, score) of the plausible matches."""
    def span(x: Column) -> Column:
        around = F.lower(F.concat_ws(" | ", x["before"], x["after"]))
        low, high = SCORES[kind]
        score = (F.when(confirmed(x["match"], kind), high).otherwise(low)
                 + F.when(around.rlike(rf"\b(?:{RAISE[kind]})"), UP).otherwise(0.0)
                 - F.when(around.rlike(rf"\b(?:{LOWER})\b"), DOWN).otherwise(0.0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"),
                        (x["start"] + F.length(x["match"])).alias("end"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    good = F.transform(F.filter(F.col(f"{kind}_at"), lambda x: plausible(x["match"], kind) & (F.length(x["match"]) > 0)), span)
    return F.coalesce(good, none)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, score), by kind as listed and start, of every row."""
    rows = proposals(shared.doc_text(docs))
    rows = rows.select("doc_id", *[F.when(F.col(f"{k}_pairs").isNotNull(), located(F.col(f"{k}_pairs"))).alias(f"{k}_at") for k in KINDS])
    spans = rows.select("doc_id", *[scored(k).alias(k) for k in KINDS])
    strong = [F.filter(k, lambda x: x["score"] >= THRESHOLD) for k in ADDED]
    return spans.select("doc_id", F.concat(*[F.col(k) for k in BASE], *strong).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256, the spans as text and the mean score."""
    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                     x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(base), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))
