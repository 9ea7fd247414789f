"""Text keys: folds that differ in alphabet and in what they do with other characters."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that no canonical decomposition takes apart, and what they fold to (fixed values).
WHOLE = {"đ": "d", "ł": "l", "ø": "o", "ħ": "h", "ı": "i", "ŧ": "t", "ß": "s", "æ": "a", "œ": "o", "ð": "d", "þ": "t"}


@functools.cache
def accents() -> tuple[str, str]:
    """(letters, what they fold to): every lower-case letter of the basic plane whose decomposition is one letter and marks."""
    pairs = dict(WHOLE)
    for code in range(0xC0, 0x10000):
        letter = chr(code)
        bare = [c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c)]
        if unicodedata.decomposition(letter) and len(bare) == 1 and bare[0] != letter and letter == letter.lower():
            pairs[letter] = WHOLE.get(bare[0], bare[0])
    return "".join(pairs), "".join(pairs.values())


def fold(value: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks after it."""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(value.cast("string"), F.lit(""))), *accents()), r"\p{M}+", "")


def key(value: Column, joiner: str = " ", keep: str = "") -> Column:
    """Folded, with every other run of characters replaced by ``joiner`` and trimmed of it."""
    spaced = F.trim(F.regexp_replace(fold(value), f"[^a-z0-9{keep}]+", " "))
    return spaced if joiner == " " else F.replace(spaced, F.lit(" "), F.lit(joiner))


def slug(value: Column) -> Column:
    return key(value, "-")


def tokens(value: Column, least: int = 1) -> Column:
    """Distinct words of the key with at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(key(value), " "), lambda w: F.length(w) >= F.greatest(F.lit(least), F.lit(1))))


def contains_words(long: Column, short: Column) -> Column:
    """Whether the words of ``short`` stand in ``long`` side by side; false if ``short`` has none."""
    return (key(short) != "") & F.concat(F.lit(" "), key(long), F.lit(" ")).contains(F.concat(F.lit(" "), key(short), F.lit(" ")))


def same_brand(a: Column, b: Column) -> Column:
    """Equal, or one inside the other; blanks match nothing."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


#: Named character references that shop pages use, ampersand last (fixed values).
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_NUMERIC = r"(&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)"


def _character(reference: Column) -> Column:
    """The character of ``&#39;`` or ``&#x27;``; what is no character stays as it is."""
    hexadecimal = F.regexp_extract(reference, "^&#[xX]([0-9A-Fa-f]+);$", 1)
    code = F.coalesce(F.conv(F.nullif(hexadecimal, F.lit("")), 16, 10), F.regexp_extract(reference, "^&#([0-9]+);$", 1)).try_cast("int")
    high = code - 0x10000
    pair = F.concat(F.hex(F.shiftright(high, 10) + 0xD800), F.hex(high.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.when(code > 0xFFFF, pair).otherwise(F.lpad(F.hex(code), 4, "0"))), "UTF-16BE")).otherwise(reference)


def decode_entities(value: Column) -> Column:
    """Numeric and hexadecimal character references, then the named ones that shop pages use; decoded once each."""
    found = F.transform(F.regexp_extract_all(value, F.lit(_NUMERIC), F.lit(1)), _character)
    parts = F.zip_with(F.split(value, _NUMERIC, -1), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    value = F.when(value.contains("&#"), F.array_join(parts, "")).otherwise(value)
    for name, char in REFERENCES:
        value = F.replace(value, F.lit(name), F.lit(char))
    return value


def clean(value: Column, most: int) -> Column:
    """Control characters and white space as single spaces, trimmed, at most ``most`` characters."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x20\x7F]+", " ")), F.lit(most))


def looks_like_spam(value: Column) -> Column:
    return F.coalesce(F.lower(value).rlike(r"https?://|www\.|\.(com|net|org)($|[^a-z])"), F.lit(False))


def looks_like_coordinates(value: Column) -> Column:
    return F.coalesce(value.rlike(r"-?[0-9]{1,3}\.[0-9]{3,}[ ,;]+-?[0-9]{1,3}\.[0-9]{3,}"), F.lit(False))


def humanise_tag(tag: Column) -> Column:
    """``en:sour-milks`` as ``Sour milks``."""
    plain = F.replace(F.regexp_replace(tag, "^[a-z]{2}:", ""), F.lit("-"), F.lit(" "))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))
