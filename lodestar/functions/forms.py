"""Forms of names, numbers and times as shops write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sizes, text

#: Legal forms that end a firm's name, words that say street, and country codes of telephones (fixed values).
LEGAL_FORMS = ("ltd", "llc", "inc", "gmbh", "ag", "sa", "srl", "spa", "doo", "dooel", "shpk", "sha", "nv", "bv", "co")
STREET_WORDS = ("street", "st", "road", "rd", "avenue", "ave", "rruga", "rr", "ulica", "ul", "no", "nr")


def chain_key(value: Column) -> Column:
    """Folded letters and digits with nothing between them."""
    return F.replace(text.key(value), F.lit(" "), F.lit(""))


def two_letter_fold(value: Column) -> Column:
    """Lower case with only the two letters folded that one alphabet adds."""
    return F.translate(F.lower(F.coalesce(value, F.lit(""))), "çë", "ce")


def firm_name(value: Column) -> Column:
    """A firm's name without the legal forms at its end; null if nothing is left."""
    words = F.split(text.key(value), " ")
    legal = F.transform(words, lambda w: w.isin(*LEGAL_FORMS))
    # how many words from the front up to the last that is no legal form
    last = F.aggregate(F.transform(legal, lambda x, i: F.when(~x, i + 1).otherwise(0)), F.lit(0), lambda a, i: F.greatest(a, i))
    return F.nullif(F.array_join(F.slice(words, 1, last), " "), F.lit(""))


def street_key(value: Column) -> Column:
    """The words of an address that tell streets apart, numbers included."""
    return F.array_join(F.filter(F.split(text.key(value), " "), lambda w: ~w.isin(*STREET_WORDS)), " ")


def display_name(*choices: Column) -> Column:
    """The first choice that is more than white space."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in choices))


def phone_class(raw: Column, country: str, digits: int, foreign: list[str]) -> Column:
    """struct(phone, fault): a number with the country's code and so many digits after it, else what is wrong with it."""
    number = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    fault = F.when(number == "", "none")
    for code in foreign:
        fault = fault.when(number.startswith(code), f"code {code}")
    fault = fault.when(~number.startswith(country), "no code").when(F.length(number) != len(country) + digits, F.concat((F.length(number) - len(country)).cast("string"), F.lit(" digits")))
    return F.struct(F.when(fault.isNull(), F.concat(F.lit("+"), number)).alias("phone"), fault.alias("fault"))


def clock(value: Column) -> Column:
    """``7:30 PM`` as ``19:30``; null for what is no time of day."""
    part = lambda g: F.regexp_extract(F.upper(F.trim(value)), r"^([0-9]{1,2})(?::([0-5][0-9]))? *([AP])\.?M\.?$", g)
    hour = part(1).try_cast("int")
    day = hour % 12 + F.when(part(3) == "P", 12).otherwise(0)
    return F.when(hour.between(1, 12), F.format_string("%02d:%s", day, F.coalesce(F.nullif(part(2), F.lit("")), F.lit("00"))))


def rating(value: Column) -> Column:
    """struct(rating, reviews, rounded) of ``4.5 (120)`` or ``4.2 (2.6K)``; all null for ``No reviews``."""
    part = lambda g: F.regexp_extract(value, r"^([0-9.]+) *\(([0-9.]+)([Kk]?)\)$", g)
    many = part(3) != ""
    reviews = F.round(part(2).try_cast("double") * F.when(many, 1000).otherwise(1), 0).cast("bigint")
    return F.struct(part(1).try_cast("double").alias("rating"), reviews.alias("reviews"), F.when(reviews.isNotNull(), many).alias("rounded"))


def pasted_line(line: Column) -> Column:
    """A pasted "name - rating . kind . address . more" line as a struct; null without the dash.

    More parts are a phone, hours ("Open 24 hours", "Opens 7 AM", "Closes 10 PM"), or services.
    """
    halves = F.split(line, " *— *", 2)
    parts = F.filter(F.transform(F.split(F.get(halves, F.lit(1)), "·"), lambda x: F.trim(x)), lambda x: x != "")
    more = F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1)))
    first = lambda pattern: F.get(F.filter(more, lambda x: x.rlike(pattern)), F.lit(0))
    after = lambda word: clock(F.regexp_replace(first(f"(?i)^{word} [0-9]"), f"(?i)^{word} ", ""))
    known = r"(?i)^(\+.*|open 24 hours|open|closed|opens [0-9].*|closes [0-9].*)$"
    scored = rating(F.get(parts, F.lit(0)))
    return F.when(
        F.size(halves) == 2,
        F.struct(
            F.get(halves, F.lit(0)).alias("name"), scored["rating"].alias("rating"), scored["reviews"].alias("reviews"), F.get(parts, F.lit(1)).alias("kind"), F.get(parts, F.lit(2)).alias("address"),
            first(r"^\+").alias("phone"), F.when(first("(?i)^open 24 hours$").isNotNull(), "24/7").alias("hours"), after("opens").alias("opens"), after("closes").alias("closes"),
            F.filter(more, lambda x: ~x.rlike(known)).alias("services"),
        ),
    )


def dedupe_key(code: Column, name: Column, row: Column) -> Column:
    """Eight digits or more of a code, else the name without pack counts, else the row's own id."""
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9]", "")
    named = text.key(sizes.match_name(name))
    return F.when(F.length(digits) >= 8, F.concat(F.lit("code:"), digits)).when(named != "", F.concat(F.lit("name:"), named)).otherwise(F.concat(F.lit("row:"), row.cast("string")))


def best_size(field: Column, title: Column) -> Column:
    """struct(shown, source): a size of the quantity field, else by weight, else the title's size, else its pieces."""
    own, named, pieces = sizes.format_size(sizes.parse_size(field)), sizes.format_size(sizes.parse_size(title)), sizes.piece_count(title)
    source = F.when(own.isNotNull(), "field").when(sizes.is_sold_by_weight(title), "weight").when(named.isNotNull(), "title").when(pieces.isNotNull(), "pieces")
    shown = F.when(source == "field", own).when(source == "weight", "1 kg").when(source == "title", named).when(source == "pieces", F.concat(pieces.cast("string"), F.lit(" pcs")))
    return F.struct(shown.alias("shown"), source.alias("source"))


def mark(name: Column, yes: list[str], no: list[str]) -> Column:
    """True, false or null by the words of a name; ``no`` outweighs ``yes``."""
    words = F.split(text.key(name), " ")
    return F.when(F.exists(words, lambda w: w.isin(*no)), False).when(F.exists(words, lambda w: w.isin(*yes)), True)


def reply_faults(reply: Column, retrieved: Column, brands: list[str], banned: list[str]) -> Column:
    """Brands that a reply names though they were not retrieved, and claims that no reply may make."""
    said = F.concat(F.lit(" "), text.key(reply), F.lit(" "))
    key = lambda b: " ".join(b.lower().split())
    stray = F.array(*(F.when(said.contains(f" {key(b)} ") & ~F.array_contains(retrieved, b), F.lit(f"brand {b}")) for b in brands))
    claims = F.array(*(F.when(said.contains(f" {key(c)} "), F.lit(f"claim {c}")) for c in banned))
    return F.array_compact(F.concat(stray, claims))
