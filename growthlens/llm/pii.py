"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

Everything is a column expression over one row's text; nothing is shuffled.  A kind's matches come from
``regexp_extract_all`` and the gaps between them from ``split`` by the same expression, so the code-point offsets are
prefix sums of both lengths (by doubling, which keeps texts with a great many matches from costing their square).
The expressions use possessive quantifiers and start only where a run starts (or the last match ended), so neither the
stack nor the time grows badly on long runs; the matches are those of the plain forms.

The kinds email, ip, card and phone are confirmed by their own check alone.  IBANs have their country's length and need
mod-97.  A number written like a social security number (no area 000, 666 or 9xx, no group 00, no serial 0000) needs a
context word to reach ``MIN_SCORE``.

Defined cases: NULL text is empty and has no spans; spans of different kinds may overlap; repeated rows are kept; a
doc_id may be NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

MIN_SCORE = 0.5
#: Code points before and after a span in which a context word counts, and what it adds.
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3

_SPAN = "array<struct<start: int, end: int, match: string, score: double>>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def is_ip(match: Column) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def is_card(match: Column) -> Column:
    d = digits(match)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def is_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def is_iban(match: Column) -> Column:
    """ISO 13616: the first four characters go to the end, letters count 10 to 35, the number leaves 1 mod 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda ch: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ch) - 1
    left = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(
        (acc * F.when(value(ch) > 9, 100).otherwise(10) + value(ch)) % 97))
    return F.length(plain).between(15, 34) & (left == 1)


# The length of an IBAN by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DJ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    """Two letters, two digits and as many characters as the country's accounts have, in groups by blanks or not."""
    kinds = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}"
                     for length, codes in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{kinds})(?![A-Za-z0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    regex: str
    valid: object = None
    score: float = 1.0
    context: str = ""
    needs: str = ""  # a character without which there is no match


#: In the order in which spans are listed; the first four are the base kinds.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, 0.9, "mail|contact|write", "@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", is_ip, 0.7, "ip|host|server|address", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", is_card, 0.8, "card|visa|master|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", is_phone, 0.7, "phone|call|tel|mobile|fax", "+"),
    Kind("iban", _iban(), is_iban, 0.9,
         "iban|account|bank|konto"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", None, 0.3, "ssn|social|security|tax"),
]
BASE = ("email", "ip", "card", "phone")


def _running(values: Column, combine) -> Column:
    """Running sums or the like of an int array in log2(n) passes."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))
    return F.aggregate(rounds, values, lambda acc, r: F.transform(acc, lambda x, i: combine(x, F.coalesce(
        F.get(acc, i - F.call_function("shiftleft", F.lit(1), r)), F.lit(0)))))


def _prefix_sums(values: Column) -> Column:
    return _running(values, lambda x, y: x + y)


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.instr(text, kind.needs) > 0, found).otherwise(none) if kind.needs else found


def _context(text: Column, start: Column, end: Column, words: str) -> Column:
    low = F.greatest(start - CONTEXT_CHARS, F.lit(0))
    near = F.concat_ws(" ", F.substr(text, low + 1, start - low), F.substr(text, end + 1, F.lit(CONTEXT_CHARS)))
    return F.lower(near).rlike(rf"\b(?:{words})")


def spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind: start, end (exclusive, in code points), match and score."""
    def placed(found: Column) -> Column:
        gaps = F.split(text, kind.regex, -1)
        steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.char_length(m) + F.char_length(g))
        return let(_prefix_sums(steps), lambda ends: F.transform(found, lambda m, i: F.struct(
            (ends[i] - F.char_length(m)).alias("start"), ends[i].alias("end"), m.alias("match"))))

    def scored(s: Column) -> Column:
        bonus = F.when(_context(text, s["start"], s["end"], kind.context), CONTEXT_BONUS).otherwise(0.0)
        return F.struct(s["start"], s["end"], s["match"],
                        F.least(F.lit(1.0), F.lit(kind.score) + bonus).alias("score"))

    def confirmed(found: Column) -> Column:
        some = let(placed(found), lambda all_: F.filter(
            all_, (lambda s: kind.valid(s["match"])) if kind.valid else (lambda s: F.lit(True))))
        kept = F.filter(F.transform(some, scored), lambda s: s["score"] >= MIN_SCORE)
        return F.when(F.size(found) > 0, kept.cast(_SPAN)).otherwise(F.array().cast(_SPAN))

    return let(_matches(text, kind), confirmed)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, the array of its spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select(
        "doc_id", *[spans(F.col("text"), k).alias(k.name) for k in KINDS])


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest, all spans as kind:start:end, and the scores of the spans in that order."""
    def listed(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]))

    found = find(docs)
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.concat(*[listed(k) for k in BASE]), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[listed(k.name) for k in KINDS]), ",").alias("spans"),
        F.array_join(F.concat(*[F.transform(k.name, lambda s: s["score"].cast("string")) for k in KINDS]), ",")
        .alias("scores"))


def _cut(text: Column) -> Column:
    """``text`` with its confirmed spans replaced; spans that overlap go as one, named by the first (the longest)."""
    def marked(kind: Kind) -> Column:
        return F.transform(spans(text, kind), lambda s: F.struct(
            s["start"], (-s["end"]).alias("back"), F.lit(f"[{kind.name.upper()}]").alias("mark")))

    def without(found: Column) -> Column:
        ends = _running(F.transform(found, lambda s: -s["back"]), F.greatest)
        return let(ends, lambda reach: pieces(found, reach))

    def pieces(found: Column, reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
        heads = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: F.get(found, i)["start"] >= before(i))
        parts = F.transform(heads, lambda i: F.concat(
            F.substr(text, before(i) + 1, F.get(found, i)["start"] - before(i)), F.get(found, i)["mark"]))
        return F.concat(F.array_join(parts, ""), F.substr(text, before(F.size(found)) + 1))

    return let(F.array_sort(F.concat(*[marked(k) for k in KINDS])),
               lambda found: F.when(F.size(found) == 0, text).otherwise(without(found)))


def redacted(text: Column) -> Column:
    """``text`` with its confirmed spans replaced by the names of their kinds in brackets.

    All spans of the text are cut at once; then, kind after kind, what is a match only in the text that is left.
    """
    def of(text: Column, kind: Kind) -> Column:
        mark = F.lit(f"[{kind.name.upper()}]")

        def join(found: Column, hit) -> Column:
            return F.array_join(F.zip_with(F.split(text, kind.regex, -1), found, lambda gap, m: F.concat(
                gap, F.when(hit(m), mark).otherwise(F.coalesce(m, F.lit(""))))), "")

        def rebuilt(found: Column) -> Column:
            if kind.score >= MIN_SCORE:  # the match alone decides
                return join(found, lambda m: m.isNotNull() & (kind.valid(m) if kind.valid else F.lit(True)))
            return let(F.transform(spans(text, kind), lambda s: s["match"]),
                       lambda hits: join(found, lambda m: F.array_contains(hits, m)))

        return let(_matches(text, kind), lambda found: F.when(F.size(found) == 0, text).otherwise(rebuilt(found)))

    def step(kind: Kind):
        return lambda t: of(t, kind)

    text = let(text, _cut)
    for kind in KINDS:
        text = let(text, step(kind))
    return text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; NULL texts stay NULL."""
    return docs.withColumn("text", redacted(F.col("text")))
