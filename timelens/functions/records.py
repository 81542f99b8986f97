"""Reading one field of a raw journal record, whose values have no fixed type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Integer texts, the white space characters of Unicode.
INTEGER = r"^[+-]?[0-9]+$"
WHITE_SPACE = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The JSON string a text begins with.
FIRST_STRING = r'^"(?:[^"\\]++|\\.)*+"'

# Closes the array a line is wrapped in. A line with anything after its own
# closing brace cannot have this as the second and last element.
END_MARK = "end-of-journal-line"


def parsed(line: Column) -> Column:
    """The line as a variant array ``[record, END_MARK]``; NULL if it is not JSON.

    The JSON parser stops at the end of the first value, so a bare line with
    trailing text would be accepted. Inside the array it is not.
    """
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(f',"{END_MARK}"]')))


def is_record(line: Column, document: Column) -> Column:
    """True when the line is exactly one JSON object."""
    closes = F.try_variant_get(document, "$[1]", "string") == END_MARK
    alone = F.try_variant_get(document, "$[2]", "variant").isNull()
    opens = F.ltrim(line, F.lit(" \t\r\n")).startswith("{")
    return F.coalesce(opens & closes & alone, F.lit(False))


# Parts of a double's shortest text: sign, whole digits, fraction, exponent.
NUMBER = r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:E(-?[0-9]+))?$"


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _shifted(part: Column) -> Column:
    """Decimal text of the parts of a number: sign, digits, and how many of them stand before the point."""
    sign, digits, place = part["sign"], part["digits"], part["place"]
    before = F.when(place > 0, F.rpad(F.substr(digits, F.lit(1), place), place, "0")).otherwise("0")
    behind = F.when(place > 0, F.substr(digits, place + 1)).otherwise(F.lpad(digits, F.length(digits) - place, "0"))
    text = F.concat(sign, F.regexp_replace(before, "^0+(?=[0-9])", ""), F.lit("."), behind)
    return F.regexp_replace(F.rtrim(text, F.lit("0")), r"\.$", "")


def plain_number(text: Column) -> Column:
    """A JSON number as plain decimal text, never with an exponent, of any size.

    The point of the shortest text is shifted by its exponent.
    """
    def parts(shortest: Column) -> Column:
        whole = F.regexp_extract(shortest, NUMBER, 2)
        return F.when(shortest.rlike(NUMBER), F.struct(
            F.regexp_extract(shortest, NUMBER, 1).alias("sign"),
            F.concat(whole, F.rtrim(F.regexp_extract(shortest, NUMBER, 3), F.lit("0"))).alias("digits"),
            (F.length(whole) + F.coalesce(F.regexp_extract(shortest, NUMBER, 4).try_cast("int"), F.lit(0))).alias("place"),
        ))

    return F.coalesce(let(let(text.try_cast("double").cast("string"), parts), _shifted), F.lit(""))


def fields(document: Column, names: list[str]) -> Column:
    """Array of the named fields as texts: strings as they are, numbers in plain
    decimal, arrays by their first element at any depth, anything else empty."""
    values = [F.try_variant_get(document, f"$[0]['{name}']", "variant") for name in names]
    return F.transform(F.array(*values), text_of)


def text_of(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    # the first element of the innermost array, with everything behind it
    opened = F.regexp_replace(F.to_json(value), r"^\[+", "")

    def by_kind(kind: Column) -> Column:
        listed = kind.startswith("ARRAY")
        number = F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), text).when(
            listed & opened.rlike("^[-0-9]"), F.regexp_extract(opened, r"^[^,\]]+", 0))
        first = F.from_json(F.concat(F.lit("["), F.regexp_extract(opened, FIRST_STRING, 0), F.lit("]")), "array<string>")[0]
        return (
            F.when(kind == "STRING", text).when(listed & opened.startswith('"'), first)
            .otherwise(plain_number(number)))

    return F.coalesce(let(F.schema_of_variant(value), by_kind), F.lit(""))


def first_filled(*texts: Column) -> Column:
    """The first text that is more than white space, untrimmed; else empty."""
    return F.coalesce(*[F.when(F.trim(t, F.lit(WHITE_SPACE)) != "", t) for t in texts], F.lit(""))


def integer(text: Column, kind: str) -> Column:
    """The text as an integer of ``kind``; NULL where it is not exactly one."""
    return F.when(text.rlike(INTEGER), text.try_cast(kind))
