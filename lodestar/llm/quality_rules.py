"""Line-first quality rules, in DataFrame expressions only.

Method.  Every line that holds a word is judged: as symbol noise, as shouting and as boilerplate by itself; as
navigation and for want of punctuation together with the lines right above and below it.  A line without a
sentence mark is like a link if it is short, in title case, or cut by separators; such a line fails as
navigation unless it runs on from, or into, a line of prose beside it.  A longer line without a mark fails for want
of punctuation only if neither neighbour has a mark and no sentence runs across the line break, so prose
that is wrapped at a fixed width stays.  Scripts that write sentences without marks (Thai, Lao, Tibetan, Burmese,
Khmer) are exempt from both.  Lines that fail are removed, and a document that loses
more than ``MAX_LOST_PERCENT`` of its words to that is rejected, as is one that fails the base measures
(too few words, or too many words in repeated windows).  All measures are taken over the whole text.

Everything is computed inside the row: no text is exploded or shuffled, so neither the length of a
document nor a hot source matters.  Windows of eight words are compared by their 64-bit hashes.

Defined results: a null, empty or wordless text has zero measures and fails for its few words; repeated
rows and rows with a null or repeated id each get a row; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, and
``clean`` keeps every other column as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_LOST_PERCENT = 50
#: Rules for a line; all are parameters of the method.
SYMBOLS = "[#*$%&|<>]"
MAX_SYMBOLS_PER_10_WORDS = 3
MIN_SYMBOLS = 3
MIN_SHOUTED_LETTERS = 10
NAVIGATION_WORDS = 5
BOILERPLATE_WORDS = 30
LINK_TITLE_WORDS, LINK_LIST_WORDS = 10, 30
#: Marks inside and at the end of sentences: Unicode's sentence terminals of scripts in use, and commas and the like.
SENTENCE_MARKS = "[.!?:;,…‼‽⁇-⁉。！？：；，、．｡։՝՜؟،؛۔܀-܂߹।॥၊။።-፨᙮᠂᠃᠉᥄᥅᭚᭛᭞᭟᰻᰼᱾᱿꓾꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝-꩟꫰꫱꯫។៕།༎]"
#: Scripts whose sentences need no mark: Thai, Lao, Tibetan, Burmese, Khmer.
UNMARKED_SCRIPTS = "[\u0e00-\u109f\u1780-\u17ff]"
SEPARATORS = "[|»›→•·]| [/>–-] "
#: Fewest capitals of a line that shouts: more than half of MIN_SHOUTED_LETTERS.
MIN_SHOUTED = MIN_SHOUTED_LETTERS // 2 + 1
BOILERPLATE = (
    "all rights reserved|licensed under|released under|copyright|terms of (use|service)|privacy policy|"
    "cookie|javascript|subscribe to|sign (in|up)|log ?in|click here|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|tous droits réservés|politique de confidentialité|mentions légales|"
    "todos los derechos reservados|política de privacidad|aviso legal|tutti i diritti riservati|informativa sulla privacy"
)

_WS = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def phrases(pattern: str = BOILERPLATE) -> list[str]:
    """The fixed phrases that a pattern of alternatives, groups of alternatives and optional blanks stands for."""
    found = []
    for one in re.split(r"\|(?![^(]*\))", pattern):
        head, _, rest = one.partition("(")
        forms = [head + x + rest.partition(")")[2] for x in rest.partition(")")[0].split("|")] if rest else [one]
        found += [f for x in forms for f in ({x.replace(" ?", " "), x.replace(" ?", "")} if " ?" in x else [x])]
    return sorted(found)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(text: str) -> str:
    """SQL for the words of a text that is not null; [''] where it has none."""
    return f"split(btrim({text}, '{_TRIM}'), {_sql_text(_WS)})"


def _without(text: str, pattern: str) -> str:
    return f"length({text}) - length(regexp_replace({text}, {_sql_text(pattern)}, ''))"


def line_features(l: str, word: str, count: str, gone: str) -> dict[str, str]:
    """SQL for what the rules look at in a line ``l``; ``word``, ``count``, ``gone``: patterns and forms of an engine."""
    return {
        "w": count.format(l),
        "s": gone.format(l, SYMBOLS),
        "u": gone.format(l, "\\p{Lu}"),
        "a": gone.format(l, "\\p{L}"),
        "marked": word.format(l, SENTENCE_MARKS),
        "bare": word.format(l, UNMARKED_SCRIPTS),
        "cut": word.format(l, SEPARATORS),
        "lower": word.format(l, "(^|[\\x20\\x09-\\x0D])\\p{Ll}"),
        "starts": word.format(l, "^[^\\p{L}]*[\\p{Ll}\\p{Lo}]"),
        "boiler": word.format(f"lower({l})", BOILERPLATE),
    }


def stays(e: str, p: str, n: str) -> str:
    """SQL: whether the line ``e``, with ``p`` right above and ``n`` right below it (null: none), passes every rule."""
    link = lambda x: f"""(NOT {x}.marked AND NOT {x}.bare AND ({x}.w <= {NAVIGATION_WORDS} OR ({x}.cut AND {x}.w <= {LINK_LIST_WORDS})
        OR (NOT {x}.lower AND {x}.u > 0 AND {x}.w <= {LINK_TITLE_WORDS})))"""  # noqa: E731
    prose = lambda x: f"coalesce({x}.w > {NAVIGATION_WORDS} AND NOT {link(x)}, false)"
    flows = f"(({prose(p)} AND {e}.starts) OR ({prose(n)} AND coalesce({n}.starts, false)))"
    noise = f"({e}.s >= {MIN_SYMBOLS} AND 10 * {e}.s > {MAX_SYMBOLS_PER_10_WORDS} * {e}.w)"
    shout = f"({e}.a >= {MIN_SHOUTED_LETTERS} AND 2 * {e}.u > {e}.a)"
    boiler = f"({e}.boiler AND {e}.w <= {BOILERPLATE_WORDS})"
    navigation = f"({link(e)} AND NOT {flows})"
    beside = f"(coalesce({p}.marked, false) OR coalesce({n}.marked, false) OR {flows})"
    unpunctuated = f"(NOT {e}.marked AND NOT {e}.bare AND NOT {link(e)} AND NOT {beside})"
    return f"NOT ({noise} OR {shout} OR {boiler} OR {navigation} OR {unpunctuated})"


def _repeated(win: str) -> str:
    """SQL: words covered by windows that occur twice or more, from the windows' hashes in order."""
    return f"""CASE WHEN size(array_distinct({win})) = size({win}) THEN 0L ELSE aggregate(
        transform(array(sort_array(transform({win}, (x, i) -> named_struct('x', x, 'i', i)))),
            s -> sort_array(transform(filter(s, (e, k) -> e.x <=> get(s, k - 1).x OR e.x <=> get(s, k + 1).x), e -> e.i))),
        0L, (t, p) -> t + aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))),
            0L, (m, v) -> m + v)) END"""


def measure(docs: DataFrame, hidden: str = "quality_") -> DataFrame:
    """``docs`` with its measures and ``clean_text`` under a struct column ``hidden``."""
    worded = f"l rlike {_sql_text('[^' + _WS[1:-2] + ']')}"
    found = line_features("l", "{0} rlike '{1}'", f"IF({worded}, size({_words('l')}), 0)", "length({0}) - length(regexp_replace({0}, '{1}+', ''))")
    found = {k: v if k == "w" else v.replace(chr(92), chr(92) * 2) for k, v in found.items()}
    # symbols and phrases need no pattern; letters count only where capitals do, and what follows only in lines without a mark
    found["s"] = f"length(l) - length(translate(l, {_sql_text(SYMBOLS[1:-1])}, ''))"
    found["boiler"] = " OR ".join(f"contains(lower(l), {_sql_text(p)})" for p in phrases())
    early = ", ".join(f"'{k}', {found[k]}" for k in ("w", "s", "u", "marked", "boiler", "starts"))
    late = ", ".join(f"'{k}', IF(x.marked, false, {found[k].replace('l rlike', 'x.line rlike')})" for k in ("bare", "cut", "lower"))
    letters = f"IF(x.u >= {MIN_SHOUTED}, {found['a'].replace('(l)', '(x.line)').replace('(l,', '(x.line,')}, 0)"
    features = f"transform({hidden}.lines, l -> named_struct('line', l, {early}))"
    kept = ", ".join(f"'{k}', x.{k}" for k in ("line", "w", "s", "u", "marked", "boiler", "starts"))
    features = f"transform({features}, x -> named_struct({kept}, {late}, 'a', {letters}))"
    # the lines above and below; a line without a word is none
    beside = lambda at: f"IF(get({hidden}.lines, {at}).w > 0, get({hidden}.lines, {at}), NULL)"
    plain = f"e.marked AND e.s < {MIN_SYMBOLS} AND e.u < {MIN_SHOUTED} AND NOT e.boiler"
    passes = f"IF({plain}, true, get(transform(array(named_struct('p', {beside('i - 1')}, 'n', {beside('i + 1')})), b -> {stays('e', 'b.p', 'b.n')}), 0))"
    text = docs.withColumn(hidden, F.expr("named_struct('text', coalesce(cast(text AS string), ''))"))
    text = text.withColumn(
        hidden,
        F.expr(
            f"""named_struct('text', {hidden}.text,
            'words', CASE WHEN btrim({hidden}.text, '{_TRIM}') = '' THEN array() ELSE {_words(hidden + '.text')} END,
            'lines', split({hidden}.text, '\\n'))"""
        ),
    )
    text = text.withColumn(
        hidden,
        F.expr(
            f"""named_struct('n_words', size({hidden}.words),
            'word_chars', length(array_join({hidden}.words, '')),
            'n_symbols', {_without(hidden + '.text', SYMBOLS + '+')},
            'n_dup_lines', size(filter({hidden}.lines, l -> {worded})) - size(array_distinct(filter({hidden}.lines, l -> {worded}))),
            'windows', CASE WHEN size({hidden}.words) > {WINDOW}
                THEN transform(sequence(1, size({hidden}.words) - {WINDOW - 1}), i -> xxhash64(slice({hidden}.words, i, {WINDOW})))
                ELSE array() END,
            'lines', {features})"""
        ),
    )
    text = text.withColumn(
        hidden,
        F.expr(
            f"""named_struct('n_words', {hidden}.n_words, 'word_chars', {hidden}.word_chars, 'n_symbols', {hidden}.n_symbols,
            'n_dup_lines', {hidden}.n_dup_lines, 'n_repeat_words', {_repeated(hidden + '.windows')},
            'n_lines', size(filter({hidden}.lines, e -> e.w > 0)),
            'good', filter({hidden}.lines, (e, i) -> e.w > 0 AND {passes}))"""
        ),
    )
    text = text.withColumn(
        hidden,
        F.expr(
            f"""named_struct('n_words', {hidden}.n_words, 'word_chars', {hidden}.word_chars, 'n_symbols', {hidden}.n_symbols,
            'n_dup_lines', {hidden}.n_dup_lines, 'n_repeat_words', {hidden}.n_repeat_words,
            'lines_removed', {hidden}.n_lines - size({hidden}.good),
            'words_lost', {hidden}.n_words - aggregate({hidden}.good, 0L, (t, e) -> t + e.w),
            'clean_text', array_join(transform({hidden}.good, e -> e.line), '\\n'))"""
        ),
    )
    return text


def _verdicts(q: str = "quality_") -> dict[str, Column]:
    failed = f"({q}.n_words < {MIN_WORDS} OR 100 * {q}.n_repeat_words > {MAX_REPEAT_PERCENT} * {q}.n_words)"
    kept = f"(NOT {failed} AND 100 * {q}.words_lost <= {MAX_LOST_PERCENT} * {q}.n_words)"
    return {"base_failed": F.expr(failed), "kept": F.expr(kept)}


def quality_rules(docs: DataFrame) -> DataFrame:
    """The measures and the verdict of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines_removed", "words_lost"]
    verdicts = _verdicts()
    return measure(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select(
        "doc_id",
        *(F.col(f"quality_.{n}").cast("bigint").alias(n) for n in names),
        verdicts["base_failed"].alias("base_failed"),
        verdicts["kept"].alias("kept"),
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their failing lines removed and ``n_chars``, if there, brought up to date."""
    # the row number keeps the filter above the measures; pushed below them, it would work them out again and again
    hidden = free_name(docs, "quality_")
    row = free_name(docs, "quality_row_")
    rows = measure(docs, hidden).withColumn(row, F.monotonically_increasing_id())
    out = rows.where(_verdicts(hidden)["kept"] & (F.col(row) >= 0)).withColumn("text", F.col(f"{hidden}.clean_text")).drop(hidden, row)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


_ORACLE_FEATURES = line_features(
    "line", "regexp_matches({0}, '{1}')", f"len(list_filter(regexp_split_to_array({{0}}, '{_WS}'), lambda x: x <> ''))", "length({0}) - length(regexp_replace({0}, '{1}', '', 'g'))"
)
_ORACLE_LINE = f"""
    SELECT doc_id, line, ord, {", ".join(f"{v} AS {k}" for k, v in _ORACLE_FEATURES.items())}
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS ord FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')"""

#: The same measures and rules, by joins over exploded lines and windows.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS ws FROM d),
judged AS ({_ORACLE_LINE}),
by_line AS (
    SELECT e.doc_id, count(*) - count(DISTINCT e.line) AS n_dup_lines,
           sum(CASE WHEN {stays("e", "p", "n")} THEN 0 ELSE 1 END)::BIGINT AS lines_removed,
           sum(CASE WHEN {stays("e", "p", "n")} THEN 0 ELSE e.w END)::BIGINT AS words_lost
    FROM judged e LEFT JOIN judged p ON p.doc_id = e.doc_id AND p.ord = e.ord - 1 LEFT JOIN judged n ON n.doc_id = e.doc_id AND n.ord = e.ord + 1
    GROUP BY e.doc_id),
windows AS (
    SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS win
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM words WHERE len(ws) >= {WINDOW})),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice WHERE n > 1) GROUP BY doc_id),
measured AS (
    SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(length(array_to_string(w.ws, '')), 0)::BIGINT AS word_chars,
           (length(w.t) - length(regexp_replace(w.t, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
           coalesce(b.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words,
           coalesce(b.lines_removed, 0)::BIGINT AS lines_removed, coalesce(b.words_lost, 0)::BIGINT AS words_lost
    FROM words w LEFT JOIN by_line b USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
        AND 100 * words_lost <= {MAX_LOST_PERCENT} * n_words) AS kept
FROM measured"""
