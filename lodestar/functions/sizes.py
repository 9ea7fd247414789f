"""Pack sizes in product titles, and unit prices.

A title is split once into tokens: numbers, words and single signs.  Everything else is a rule on places in
that array: a unit with a number before it is a size ("500 g"), a times sign with a count on either side
makes it a pack ("6 x 1.5 l", "1.5 l x 6"), and only a title without such a size is read the other way
round, the unit before its number ("g 100 x 4").  Sizes that name different quantities cancel out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once

#: Unit spellings: canonical unit, kind, and grams or millilitres in one (fixed values).
UNITS = {
    "kg": ("kg", "mass", 1000.0),
    "g": ("g", "mass", 1.0),
    "gr": ("g", "mass", 1.0),
    "l": ("l", "volume", 1000.0),
    "lt": ("l", "volume", 1000.0),
    "lit": ("l", "volume", 1000.0),
    "ml": ("ml", "volume", 1.0),
    "cl": ("cl", "volume", 10.0),
    "dl": ("dl", "volume", 100.0),
}
#: Words for pieces, and bounds of packs, of grams or millilitres, and of pieces (fixed values).
PIECES = ("pcs", "pc", "pz", "kom", "cop")
MAX_PACKS, MAX_TOTAL, MAX_PIECES = 200, 50_000, 5_000

#: A number, a word (which ends before an x that a digit follows), or one other sign.
_TOKEN = r"([0-9]+(?:[.,][0-9]+)?|\p{L}+?(?=x[0-9])|\p{L}+|[^\s\p{L}0-9])"


def tokens(title: Column) -> Column:
    """The numbers, words and signs of a title in order, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit(_TOKEN), F.lit(1))


def _number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit(".")).try_cast("double")


def _count(token: Column) -> Column:
    """A whole number, else null."""
    return F.when(token.rlike("^[0-9]{1,9}$"), token.cast("int"))


def _is(token: Column, *words: str) -> Column:
    return F.coalesce(token.isin(*words), F.lit(False))


def _times(token: Column) -> Column:
    return _is(token, "x", "*", "×")


def _units() -> Column:
    spec = lambda u: F.struct(*(F.lit(v).alias(k) for k, v in zip(("unit", "kind", "factor"), UNITS[u], strict=True)))
    return F.create_map(*(x for u in UNITS for x in (F.lit(u), spec(u))))


def _sizes(t: Column) -> Column:
    """Every size that the tokens name: those with the number before its unit, or else those after it."""
    places = F.filter(F.transform(t, lambda w, i: F.when(_is(w, *UNITS), i)), lambda i: i.isNotNull())

    def size(i: Column, number: Column, packs: Column) -> Column:
        spec, value = F.element_at(_units(), F.get(t, i)), _number(number)
        return F.struct(
            value.alias("value"), spec["unit"].alias("unit"), F.coalesce(packs, F.lit(1)).alias("count"), spec["kind"].alias("kind"),
            F.round(value * spec["factor"] * F.coalesce(packs, F.lit(1)), 3).alias("total"),
        )

    def forward(i: Column) -> Column:
        ahead = F.when(_times(F.get(t, i - 2)), _count(F.get(t, i - 3)))
        behind = F.when(_times(F.get(t, i + 1)) & ~_is(F.get(t, i + 3), *UNITS), _count(F.get(t, i + 2)))
        return size(i, F.get(t, i - 1), F.coalesce(ahead, behind))

    def backward(i: Column) -> Column:
        at = i + F.when(_is(F.get(t, i + 1), "."), 2).otherwise(1)
        share = _is(F.get(t, at + 1), "%")
        return size(i, F.when(~share, F.get(t, at)), F.when(_times(F.get(t, at + 1)), _count(F.get(t, at + 2))))

    fits = lambda s: (s["total"] > 0) & (s["total"] <= MAX_TOTAL) & s["count"].between(1, MAX_PACKS)
    named = F.filter(F.transform(places, forward), lambda s: s["value"].isNotNull())
    either = once(named, lambda f: F.when(F.size(f) > 0, f).otherwise(F.transform(places, backward)))
    return F.filter(either, fits)


def _by_weight(t: Column) -> Column:
    def at(w: Column, i: Column) -> Column:
        near = F.get(t, i + 1)
        a_kilo = _is(w, "kg") & (_is(near, "/") | _is(F.get(t, i - 1), "/", "per"))
        coded = _is(w, "plu") & (_number(near).isNotNull() | _is(near, ".", ":") & _number(F.get(t, i + 2)).isNotNull())
        return a_kilo | coded

    return F.exists(F.transform(t, at), lambda x: x)


def is_sold_by_weight(title: Column) -> Column:
    """Priced by the kilogram ("kg/", "per kg") or with a till code ("plu 12")."""
    return once(tokens(title), _by_weight)


def parse_size(title: Column) -> Column:
    """struct(value, unit, count, kind, total) of a title, or null; total is in grams or millilitres."""

    def rule(t: Column) -> Column:
        agree = lambda s: F.size(F.array_distinct(F.transform(s, lambda x: F.struct(x["kind"], x["total"])))) == 1
        return F.when(~_by_weight(t), once(_sizes(t), lambda s: F.when(agree(s), F.get(s, F.lit(0)))))

    return once(tokens(title), rule)


def piece_count(title: Column) -> Column:
    """Pieces in a pack ("10 pcs", "10/1"), at most MAX_PIECES; else null."""

    def rule(t: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            spelled = _is(F.get(t, i + 1), *PIECES)
            slashed = _is(F.get(t, i + 1), "/") & _is(F.get(t, i + 2), "1") & ~_is(F.get(t, i - 1), "/")
            return F.when(spelled | slashed, _count(w))

        return F.get(F.filter(F.transform(t, at), lambda n: n.between(1, MAX_PIECES)), F.lit(0))

    return once(tokens(title), rule)


def match_name(name: Column) -> Column:
    """A name by its tokens, so that pack counts, till codes, decimal commas and unit spacing make no difference."""

    def rule(t: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            before, after = F.get(t, i - 1), F.get(t, i + 1)
            till = _is(w, "plu") | _is(before, "plu") | _is(before, ".", ":") & _is(F.get(t, i - 2), "plu")
            pack = _is(after, "/") & _is(F.get(t, i + 2), "1") | _is(w, "1") & _is(before, "/") & _count(F.get(t, i - 2)).isNotNull()
            unit = F.element_at(_units(), F.coalesce(after, F.lit("g")))["unit"]
            plain = F.replace(w, F.lit(","), F.lit("."))
            number = F.when(_is(after, *UNITS), F.concat(plain, unit)).otherwise(plain)
            glued = _is(w, *UNITS) & _number(before).isNotNull() & ~_is(F.get(t, i - 2), "plu")
            return F.when(till | glued, None).when(_number(w).isNotNull(), F.when(~pack, number)).when(w.rlike("^[\\p{L}]"), w)

        return F.array_join(F.transform(t, at), " ")

    return once(tokens(name), rule)


def format_size(size: Column) -> Column:
    """"6 x 1.5 l", "500 g"."""
    one = F.concat_ws(" ", F.regexp_replace(F.format_string("%.3f", size["value"]), r"\.?0+$", ""), size["unit"])
    return F.when(size.isNotNull(), F.when(size["count"] > 1, F.concat(size["count"].cast("string"), F.lit(" x "), one)).otherwise(one))


def unit_price(price: Column, total: Column) -> Column:
    """Price of a kilogram or litre; null without a price or a size."""
    return F.when((price > 0) & (total > 0), F.round(price / total * 1000, 4))
