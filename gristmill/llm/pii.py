"""Personal data in texts: patterns propose spans, checksums confirm them, context scores them.

Everything is expressed in Spark's own functions. A pattern's matches give the matched strings
and the text between them, and running totals of their lengths give the places in code points.
Patterns keep the plain meaning of the ones named in ``KINDS``, written so that Java's matcher
neither recurses nor rescans a long run of characters.

Kinds in the order of results: ``email``, ``ip`` (parts up to 255), ``card`` (13 to 19 digits
with a valid Luhn sum), ``phone`` (international, 9 to 15 digits); and, added by the method,
``iban`` (valid mod-97 sum) and ``tel`` (a national number, kept only where words before it
speak of a telephone). A span's score starts from its kind's and rises with such words nearby.

Defined results: a null text is treated as empty and has no spans; spans of different kinds may
overlap; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points before a span that are searched for context words.
CONTEXT = 40
LEAST_SCORE = 0.5
CONTEXT_GAIN = 0.3
# Running totals are taken over blocks, so that their cost stays in proportion to the matches.
BLOCK = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Kind(NamedTuple):
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    needs: str  # what any text with a match contains
    words: str  # context words
    score: float
    base: bool


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, start: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each element what ``join`` makes of ``start`` and all elements before it."""

    def of(part: Column, first: Column) -> Column:
        return F.aggregate(part, first, join)

    def whole(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: of(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), start))

        def placed(sums: Column) -> Column:
            before = F.transform(numbers, lambda b: of(F.slice(sums, F.lit(1), b), start))

            def each(first: Column) -> Column:
                def one(i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    return of(F.slice(v, block * BLOCK + 1, i - block * BLOCK), F.get(first, block))

                return F.transform(F.sequence(F.lit(0), F.size(v) - 1), one)

            return let(before, each)

        return let(blocks, placed)

    return F.when(F.size(values) > 0, let(values, whole)).otherwise(F.slice(values, 1, 0))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""

    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    places = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), worth)
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces has the check sum 1."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def fold(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), fold) == 1


def _valid_ip(m: Column) -> Column:
    def small(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.length(number) <= 3, number.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(m, "\\."), small)


def _valid_card(m: Column) -> Column:
    digits = F.translate(m, " -", "")
    return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        "@",
        "mail|contact|write",
        0.7,
        True,
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", _valid_ip, ".", "ip|host|server|address", 0.6, True),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", "[0-9](?:[\\x20-]?[0-9])++", _valid_card, "", "card|credit|visa|payment", 0.7, True),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind(
        "phone",
        "\\+[0-9][\\x20().0-9-]+[0-9]",
        lambda m: F.length(digits_of(m)).between(9, 15),
        "+",
        "phone|tel|call|fax|mobile",
        0.6,
        True,
    ),
    Kind(
        "iban",
        "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)",
        lambda m: mod97(F.translate(m, " ", "")),
        "",
        "iban|account|bank|transfer",
        0.7,
        False,
    ),
    Kind(
        "tel",
        "\\(?[0-9]{2,4}\\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}",
        lambda m: F.lit(True),
        "",
        "phone|tel|call|fax|mobile",
        0.3,
        False,
    ),
)


def _spans(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in order of start."""

    def placed(matches: Column) -> Column:
        def whole(between: Column) -> Column:
            lengths = F.transform(matches, lambda m, i: F.length(F.get(between, i)) + F.length(m))

            def spans(before: Column) -> Column:
                made = F.transform(
                    matches,
                    lambda m, i: F.struct(
                        m.alias("match"), (F.get(before, i) + F.length(F.get(between, i))).alias("start")
                    ),
                )
                valid = F.filter(made, lambda s: kind.valid(s["match"]))
                return F.transform(valid, lambda s: _scored(text, kind, s["start"], s["start"] + F.length(s["match"])))

            return let(running(lengths, F.lit(0), lambda a, x: a + x), spans)

        return F.when(F.size(matches) > 0, let(F.split(text, kind.pattern, -1), whole)).otherwise(none)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), placed)
    found = F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found
    return found if kind.base else F.filter(found, lambda s: s["score"] >= LEAST_SCORE)


def _scored(text: Column, kind: Kind, start: Column, end: Column) -> Column:
    first = F.greatest(start - CONTEXT, F.lit(0))
    nearby = F.translate(F.substring(text, first + 1, start - first), _UPPER, _LOWER).rlike(kind.words)
    return F.struct(
        F.lit(kind.name).alias("kind"),
        start.alias("start"),
        end.alias("end"),
        F.when(nearby, kind.score + CONTEXT_GAIN).otherwise(kind.score).alias("score"),
    )


def find(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``pii``: array<struct<kind, start, end, score>> by kind, then start.

    Places count code points from 0, the end is exclusive. A column named ``pii`` is replaced.
    """
    # Each kind is a column of its own, so that no expression is evaluated twice.
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn("pii", F.concat(*[_spans(body, kind) for kind in KINDS]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans: str = "pii") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def base_spans(spans: str = "pii") -> Column:
    names = [k.name for k in KINDS if k.base]
    return F.filter(spans, lambda s: s["kind"].isin(*names))


def masked(text: Column, spans: Column) -> Column:
    """The text with every stretch of overlapping spans replaced by ``<KIND>`` of its first span."""

    def whole(ordered: Column) -> Column:
        def joined(reached: Column) -> Column:
            marked = F.transform(
                ordered, lambda s, i: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), F.get(reached, i).alias("from"))
            )
            firsts = F.filter(marked, lambda s: s["start"] >= s["from"])
            parts = F.transform(
                firsts,
                lambda s: F.concat(
                    F.substring(text, s["from"] + 1, s["start"] - s["from"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")
                ),
            )
            last = F.array_max(F.transform(ordered, lambda s: s["end"]))
            return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

        return let(running(F.transform(ordered, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x)), joined)

    by_place = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.when(F.size(spans) > 0, let(F.array_sort(by_place), whole)).otherwise(text)


def mask(df: DataFrame, text: str, length: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` masked, ``length`` brought in line; null texts stay null."""
    out = find(df, text).withColumn(text, masked(F.col(text), F.col("pii"))).drop("pii")
    return out.withColumn(length, F.length(text).cast(df.schema[length].dataType)) if length else out
