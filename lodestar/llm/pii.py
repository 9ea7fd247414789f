"""Personal data by weak supervision, in DataFrame expressions only.

Method.  Candidates are the spans of four strict patterns (e-mail, IP address, payment card, phone; these
always stand) and of two loose ones (local phone numbers, opaque keys).  Five labelers vote on every
candidate: strict pattern, gazetteer, context words before it, its boundaries, and its shape; a vote is
1, -1 or 0 for no opinion.  Candidates are counted by kind, votes and features of the span (length, share
of digits, mixed case) over all documents: a table with a fixed bound.  Expectation-maximisation on it
estimates the labelers' reliabilities and the chance that a candidate of each vote pattern is real; a
logistic span classifier over kind, votes and features is trained on those chances and becomes a Spark
expression.  Loose candidates that it accepts are added unless they overlap a strict span.

Offsets come from the row itself (the text between matches, and the matches), in code points, so no text
is shuffled.  Patterns are written without backtracking over long runs.  Running sums and maxima over the
matches of a text double their reach in each round, and pieces of text are cut from parts of ``PART`` code
points, so a text with very many matches costs in proportion to its size (times the logarithm of the
matches).  Candidates are worked out once and written; counts and spans are read from there.

Defined results: a null text counts as empty and has no spans; repeated rows and rows with a null or
repeated id each get a row; an empty table gives an empty result and a classifier that adds nothing; only
``doc_id`` and ``text`` are read, and ``redact`` keeps every other column as it is.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, stage

#: Kinds as listed: strict ones first.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "gazetteer", "context", "boundary", "shape")
CONTEXT_CHARS = 40
#: Code points of a part of a text; pieces are cut from parts, as cutting from the whole reads it from its start.
PART = 1024
ROUNDS = 60

#: (kind, strict, pattern).  A candidate's text is the whole match.
CANDIDATES = (
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("phone", False, r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("secret", False, r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{24,}+"),
)
#: What a text must contain for a pattern to be tried at all.
NEEDS = {"email": "contains({t}, '@')", "phone": "(contains({t}, '+') OR NOT {strict})"}

#: Gazetteers and cue words.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at"
DIAL_CODES = r"\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = "^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
LOCAL_ADDRESSES = r"^(0|10|127|255)\.|^192\.168\.|^169\.254\."
KEY_PREFIXES = "^(AKIA|ghp_|gho_|xox[abp]-|sk-|pk_|AIza)"
CUES = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "ip|host|server|address|adresse|login",
    "card": "card|visa|master|karte|carte|tarjeta|payment",
    "phone": "phone|tel|call|mobile|fax|handy|whatsapp",
    "secret": "token|key|secret|passw|credential|auth",
}
ANTI_CUES = "version|isbn|order no|item|section|figure|checksum|commit|sha"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, join: str, other: str) -> str:
    """SQL: inclusive running ``join`` (of a and b) over an array, in rounds of doubled reach."""
    step = join.format(a="v", b=f"coalesce(get(acc, i - cast(shiftleft(1, k) AS int)), {other})")
    rounds = f"sequence(0, cast(ceil(log2(size({values}))) AS int))"
    return f"IF(size({values}) < 2, {values}, aggregate({rounds}, {values}, (acc, k) -> transform(acc, (v, i) -> {step})))"


def _cut(parts: str, start: str, length: str) -> str:
    """SQL: ``length`` code points from ``start`` (from 0) of the text whose parts are given."""
    held = f"array_join(slice({parts}, cast({start} DIV {PART} AS int) + 1, cast(({start} + {length}) DIV {PART} - {start} DIV {PART} AS int) + 1), '')"
    return f"substring({held}, cast({start} % {PART} AS int) + 1, {length})"


def _parts(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{PART}}}', 0)"


def _located(text: str, kind: str, strict: bool, pattern: str) -> str:
    """SQL: array of (m, s, e) for the matches of one pattern in order."""
    need = NEEDS.get(kind, "true").format(t=text, strict=str(strict).lower())
    none = "cast(array() AS array<struct<m:string,s:int,e:int>>)"
    gaps = f"transform(split({text}, {_q(pattern)}, -1), g -> length(g))"
    steps = "zip_with(mm, slice(gg, 1, size(mm)), (m, g) -> g + length(m))"
    found = f"zip_with(mm, ee, (m, e) -> named_struct('m', m, 's', e - length(m), 'e', e))"
    placed = _let("ee", _let("steps", steps, _running("steps", "{a} + {b}", "0")), found)
    some = _let("mm", f"regexp_extract_all({text}, {_q(pattern)}, 0)", f"IF(size(mm) = 0, {none}, {_let('gg', gaps, placed)})")
    return f"CASE WHEN {need} THEN {some} ELSE {none} END"


def _valid(kind: str, strict: bool) -> str:
    """SQL: whether the match x.m passes the checks of its kind."""
    digits = r"regexp_replace(x.m, '[^0-9]', '')"
    if kind == "ip":
        return r"forall(split(x.m, '\\.'), p -> length(ltrim('0', p)) <= 3 AND cast(right(concat('000', ltrim('0', p)), 3) AS int) <= 255)"
    if kind == "card":
        luhn = """aggregate(transform(sequence(1, length(d)), i ->
            cast(substring(d, length(d) - i + 1, 1) AS int) * IF(i % 2 = 0, 2, 1)), 0, (t, v) -> t + IF(v > 9, v - 9, v)) % 10 = 0"""
        return _let("d", digits, f"length(d) BETWEEN 13 AND 19 AND {luhn}")
    if kind == "phone" and strict:
        return f"length({digits}) BETWEEN 9 AND 15"
    return "true"


def _votes(kind: str, strict: bool, parts: str) -> str:
    """SQL: the labelers' votes on the candidate x."""
    before = "before"
    sides = f"concat(IF(x.s > 0, right(before, 1), ' '), '|', {_cut(parts, 'x.e', '1')})"
    distinct = "size(array_distinct(split(regexp_replace(x.m, '[^0-9A-Za-z]', ''), '')))"
    gazetteer = {
        "email": f"IF(lower(x.m) rlike {_q(chr(92) + '.(' + TOP_DOMAINS + ')$')}, 1, 0)",
        "ip": f"IF(x.m rlike {_q(LOCAL_ADDRESSES)}, -1, 1)",
        "card": f"IF(x.m rlike {_q(CARD_ISSUERS)}, 1, -1)",
        "phone": f"IF(x.m rlike {_q('^' + DIAL_CODES)}, 1, 0)",
        "secret": f"IF(x.m rlike {_q(KEY_PREFIXES)} OR (x.m rlike '^[0-9a-f]+$' AND length(x.m) IN (32, 40, 64)), 1, 0)",
    }[kind]
    shape = {
        "email": "IF(length(x.m) BETWEEN 6 AND 64, 1, -1)",
        "secret": "IF(x.m rlike '[0-9]' AND x.m rlike '[A-Za-z]' AND NOT x.m rlike '[/_-].*[/_-]', 1, -1)",
    }.get(kind, f"IF({distinct} >= 3, 1, -1)")
    pattern = {
        "secret": f"IF({before} rlike {_q('[=:] ?[\"' + chr(39) + ']?$')}, 1, -1)",
        "phone": "1" if strict else f"IF(x.m rlike {_q('[0-9]([ .-])[0-9]{3}' + chr(92) + '1[0-9]')}, 1, 0)",
    }.get(kind, "1")
    context = f"CASE WHEN {before} rlike {_q(ANTI_CUES)} THEN -1 WHEN {before} rlike {_q(CUES[kind])} THEN 1 ELSE 0 END"
    boundary = f"IF({sides} rlike '[0-9A-Za-z]', -1, 1)"
    seen = f"lower({_cut(parts, f'greatest(x.s - {CONTEXT_CHARS}, 0)', f'least(x.s, {CONTEXT_CHARS})')})"
    return _let("before", seen, f"array({pattern}, {gazetteer}, {context}, {boundary}, {shape})")


#: Features of a span beside its votes, each a small number: values it may have, and SQL over the candidate x.
FEATURES = {
    "length": (4, "least(3, length(x.m) DIV 12)"),
    "digits": (4, "least(3, 4 * length(regexp_replace(x.m, '[^0-9]', '')) DIV length(x.m))"),
    "mixed": (2, "IF(x.m rlike '[A-Z]' AND x.m rlike '[a-z]', 1, 0)"),
}


def candidates(docs: DataFrame, name: str = "pii_") -> DataFrame:
    """``docs`` with a column ``name``: its candidates (k, base, s, e, votes, features)."""
    out = docs.withColumn(name, F.expr("named_struct('text', coalesce(cast(text AS string), ''))"))
    text = f"{name}.text"
    fields = ", ".join(f"'f{i}', {_located(text, *c)}" for i, c in enumerate(CANDIDATES))
    out = out.withColumn(name, F.expr(f"named_struct('parts', {_parts(text)}, {fields})"))
    features = ", ".join(sql for _, sql in FEATURES.values())
    parts = [
        f"""transform(filter({name}.f{i}, x -> {_valid(kind, strict)}), x -> named_struct('k', {KINDS.index(kind)}, 'base', {str(strict).lower()},
            's', x.s, 'e', x.e, 'votes', {_votes(kind, strict, name + '.parts')}, 'features', array({features})))"""
        for i, (kind, strict, _) in enumerate(CANDIDATES)
    ]
    return out.withColumn(name, F.expr(f"concat({', '.join(parts)})"))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[dict]]:
    """(chance that a candidate of each vote pattern is real, each labeler's vote chances by class).

    ``counts``: vote patterns and how many candidates have them.
    """
    chance = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for v, _ in counts}
    tables: list[dict] = []
    for _ in range(rounds):
        total = sum(n for _, n in counts)
        real = sum(n * chance[v] for v, n in counts)
        tables = []
        for j in range(len(LABELERS)):
            seen = {(y, w): 1.0 for y in (0, 1) for w in (-1, 0, 1)}
            for v, n in counts:
                seen[1, v[j]] += n * chance[v]
                seen[0, v[j]] += n * (1 - chance[v])
            tables.append({(y, w): seen[y, w] / sum(seen[y, u] for u in (-1, 0, 1)) for y in (0, 1) for w in (-1, 0, 1)})
        prior = (real + 1) / (total + 2)
        for v, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[1, w] / t[0, w]) for t, w in zip(tables, v, strict=True))
            chance[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, tables


def _inputs(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> list[float]:
    """What the classifier sees: one number for each kind, vote for, vote against, and value of a feature."""
    values = [float(f == v) for (n, _), f in zip(FEATURES.values(), features, strict=True) for v in range(n)]
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes), *values]


Row = tuple[int, tuple[int, ...], tuple[int, ...], float, int]


def train(rows: list[Row], rounds: int = 300, step: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights of the logistic span classifier; rows: kind, votes, features, chance of being real, count."""
    data = [([i for i, x in enumerate(_inputs(k, v, f)) if x], p, n) for k, v, f, p, n in rows]
    weights = [0.0] * len(_inputs(0, (0,) * len(LABELERS), (0,) * len(FEATURES)))
    total = sum(n for *_, n in data)
    for _ in range(rounds if total else 0):
        slope = [ridge * w for w in weights]
        for on, p, n in data:
            z = sum(weights[i] for i in on)
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for i in on:
                slope[i] += miss
        weights = [w - step * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(found: DataFrame, name: str = "pii_") -> list[float]:
    """Counts over the candidates of all documents, then reliabilities, then the span classifier."""
    spans = found.select(F.explode(name).alias("x"))
    counted = spans.groupBy("x.k", "x.votes", "x.features").agg(F.count(F.lit(1)).alias("n")).collect()
    by_votes: dict[tuple[int, ...], int] = {}
    for r in counted:
        by_votes[tuple(r["votes"])] = by_votes.get(tuple(r["votes"]), 0) + r["n"]
    chance, _ = reliabilities(sorted(by_votes.items()))
    return train(sorted((r["k"], tuple(r["votes"]), tuple(r["features"]), chance[tuple(r["votes"])], r["n"]) for r in counted))


def _accepted(weights: list[float], e: str) -> str:
    n, m = 1 + len(KINDS), len(LABELERS)
    terms = [f"{weights[0]!r}D", f"CASE {e}.k {' '.join(f'WHEN {k} THEN {weights[1 + k]!r}D' for k in range(len(KINDS)))} END"]
    terms += [f"CASE {e}.votes[{j}] WHEN 1 THEN {weights[n + j]!r}D WHEN -1 THEN {weights[n + m + j]!r}D ELSE 0D END" for j in range(m)]
    at = n + 2 * m
    for j, (values, _) in enumerate(FEATURES.values()):
        terms.append(f"CASE {e}.features[{j}] {' '.join(f'WHEN {v} THEN {weights[at + v]!r}D' for v in range(values))} END")
        at += values
    return f"({' + '.join(terms)}) > 0"


def standing(weights: list[float], spans: str) -> str:
    """SQL: the spans of an array of candidates that stand (k, base, s, e), by kind as listed, then start.

    In order of their starts, a loose span stands apart if no strict one before it ends after its start and
    none after it starts before its end.
    """
    lean = "named_struct('s', x.s, 'e', x.e, 'k', x.k, 'base', x.base)"
    order = f"array_sort(transform(filter({spans}, x -> x.base OR {_accepted(weights, 'x')}), x -> {lean}))"
    before = _let("ends", "transform(xs, x -> IF(x.base, x.e, 0))", _running("ends", "greatest({a}, {b})", "0"))
    after = _let("starts", "transform(reverse(xs), x -> IF(x.base, x.s, 2147483647))", f"reverse({_running('starts', 'least({a}, {b})', '2147483647')})")
    apart = "filter(transform(xs, (x, i) -> IF(x.base OR coalesce(pe[i - 1], 0) <= x.s AND coalesce(get(ns, i + 1), x.e) >= x.e, x, null)), x -> x IS NOT NULL)"
    apart = apart.replace("pe[i - 1]", "get(pe, i - 1)")
    kept = f"IF(forall(xs, x -> x.base), xs, {_let('pe', before, _let('ns', after, apart))})"
    return f"array_sort(transform({_let('xs', order, kept)}, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'base', x.base)))"


def find(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the strict spans, and all spans of every document."""
    found = stage(candidates(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).drop("text"), "candidates")
    placed = found.withColumn("pii_", F.expr(standing(fit(found), "pii_")))
    named = "array_join(transform({a}, x -> concat(" + f"element_at(array{KINDS!r}, x.k + 1)" + ", ':', x.s, ':', x.e)), ',')"
    base = "filter(pii_, x -> x.base)"
    return placed.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(pii_, x -> x.base AND x.k = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])),
        F.sha2(F.expr(named.format(a=base)), 256).alias("base_sha256"),
        F.expr(named.format(a="pii_")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become the first's kind."""
    own = free_name(docs, "pii_")
    found = stage(candidates(docs, own), "candidates")
    by_start = f"array_sort(transform({standing(fit(found, own), own)}, x -> named_struct('s', x.s, 'e', -x.e, 'k', x.k)))"
    text = "coalesce(cast(text AS string), '')"
    # what stands before a span that no earlier span reaches into, and the span's name; at last the rest
    reach = _let("ends", "transform(xs, x -> -x.e)", _running("ends", "greatest({a}, {b})", "0"))
    gap = _cut("ps", "coalesce(get(pe, i - 1), 0)", "(x.s - coalesce(get(pe, i - 1), 0))")
    piece = f"IF(x.s >= coalesce(get(pe, i - 1), 0), concat({gap}, '<', element_at(array{KINDS!r}, x.k + 1), '>'), '')"
    rest = _cut("ps", "pe[size(pe) - 1]", f"(length({text}) - pe[size(pe) - 1])")
    joined = _let("pe", reach, f"concat(array_join(transform(xs, (x, i) -> {piece}), ''), {rest})")
    redacted = _let("xs", by_start, f"IF(size(xs) = 0, {text}, {_let('ps', _parts(text), joined)})")
    out = found.withColumn("text", F.expr(redacted)).drop(own)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def op4_weak_pii(spark, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir))
