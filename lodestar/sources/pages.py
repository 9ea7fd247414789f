"""What shop pages carry: crawling rules, JSON inside scripts, category trees, price tiles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once, running_sum
from ..functions.text import decode_entities
from .shared import stage


def _rules(robots: Column, agent: str) -> Column:
    """Array of (path, allow) of the groups that hold for ``agent``: those that name it, else those of everyone.

    A group is a run of agent lines with the rules after it; a rule without a path says nothing.
    """
    lines = F.transform(F.split(robots, "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, "#.*$", ""), "\r", "")))
    fields = F.transform(lines, lambda s: F.struct(F.lower(F.regexp_extract(s, "^([A-Za-z-]+) *:", 1)).alias("f"), F.trim(F.regexp_extract(s, "^[A-Za-z-]+ *:(.*)$", 1)).alias("v")))
    kept = F.filter(fields, lambda x: x["f"].isin("user-agent", "allow", "disallow"))

    def grouped(k: Column) -> Column:
        # a group begins at an agent line that does not follow another
        starts = F.transform(k, lambda x, i: F.when((x["f"] == "user-agent") & ((i == 0) | (F.get(k, i - 1)["f"] != "user-agent")), 1).otherwise(0))
        return F.zip_with(k, running_sum(starts), lambda x, g: F.struct(g.alias("g"), x["f"].alias("f"), F.lower(x["v"]).alias("l"), x["v"].alias("v")))

    def chosen(rows: Column) -> Column:
        of = lambda name: F.transform(F.filter(rows, lambda x: (x["f"] == "user-agent") & (x["l"] == name)), lambda x: x["g"])
        groups = once(of(agent), lambda named: F.when(F.size(named) > 0, named).otherwise(of("*")))
        mine = once(groups, lambda g: F.filter(rows, lambda x: (x["f"] != "user-agent") & (x["v"] != "") & F.array_contains(g, x["g"])))
        return F.transform(mine, lambda x: F.struct(x["v"].alias("path"), (x["f"] == "allow").alias("allow")))

    return once(once(kept, grouped), chosen)


def allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """``pages`` (host, path) with ``allowed`` and the ``rule`` that says so: the longest, the first on a tie; ``robots``: host, robots."""
    parsed = robots.select("host", _rules(F.col("robots"), agent).alias("rules"))
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    order = F.transform(fits, lambda r, i: F.struct((-F.length(r["path"])).alias("l"), i.alias("i"), r["allow"].alias("allow"), r["path"].alias("path")))
    best = F.get(F.array_sort(order), F.lit(0))
    return pages.join(parsed, "host", "left").withColumn("best_", best).select(*pages.columns, F.coalesce("best_.allow", F.lit(True)).alias("allowed"), F.col("best_.path").alias("rule"))


def balanced(value: Column, opening: str) -> Column:
    """From the first ``opening`` bracket to the one that closes it, brackets in quotes aside; null if none does.

    Quoted strings are blanked to equal length; the place where as many brackets are closed as opened is then
    the shortest prefix whose parts, cut at closing brackets, add up.
    """
    closing = {"{": "}", "[": "]", "(": ")"}[opening]
    start = F.position(F.lit(opening), value)
    quotes = r'("(?:[^"\\]|\\.)*")'

    def blanked(rest: Column) -> Column:
        gaps, quoted = F.split(rest, quotes, -1), F.regexp_extract_all(rest, F.lit(quotes), F.lit(1))
        return F.array_join(F.zip_with(gaps, quoted, lambda g, q: F.concat(g, F.coalesce(F.repeat(F.lit("."), F.length(q)), F.lit("")))), "")

    def end(parts: Column) -> Column:
        opened = running_sum(F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit(opening), F.lit(""))) - 1))
        length = running_sum(F.transform(parts, lambda p: F.length(p) + 1))
        # the last part has no bracket after it
        ends = F.zip_with(opened, length, lambda o, n: F.struct(o.alias("open"), n.alias("end")))
        return F.get(F.filter(F.slice(ends, 1, F.size(parts) - 1), lambda e: e["open"] == 0), F.lit(0))["end"]

    def cut(rest: Column) -> Column:
        return once(once(F.split(blanked(rest), f"\\{closing}", -1), end), lambda n: F.when(n.isNotNull(), F.substr(rest, F.lit(1), n)))

    return F.when(start > 0, once(F.substr(value, start), cut))


def leaves(rows: DataFrame, key: str, json: str, top: str, below: str) -> DataFrame:
    """(key, path): names from the root to each leaf of a category tree under ``top``, however deep.

    Level by level until none is left; a level is written before the next is cut out of it.  A node without
    a list ``below`` it, or with an empty one, is a leaf.
    """
    name = F.trim(F.regexp_replace(F.coalesce(F.get_json_object("node", "$.name"), F.lit("")), r"[\t\r\n]+", " "))
    under = lambda path, value: F.from_json(F.get_json_object(value, f"$.{path}"), "array<string>")
    level = stage(rows.select(key, F.explode(under(top, json)).alias("node")).withColumn("path", name), "leaves")
    found = []
    while not level.isEmpty():
        split = level.withColumn("under", under(below, "node"))
        found.append(split.where("under IS NULL OR size(under) = 0").select(key, "path"))
        inner = split.select(key, F.col("path").alias("above"), F.explode("under").alias("node"))
        level = stage(inner.select(key, "node", F.concat_ws("/", "above", name).alias("path")), "leaves")
    return functools.reduce(DataFrame.unionByName, found) if found else level.select(key, "path")


def tiles(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, price) of every product tile; a price with a decimal comma, null where a tile has none."""
    tile = F.explode(F.expr(f"slice(split({html}, '<div class=\"tile\">'), 2, 2147483647)")).alias("tile")
    cut = rows.select(key, tile)
    price = F.replace(F.regexp_extract("tile", r'class="price">\s*([0-9]+(?:[.,][0-9]+)?)', 1), F.lit(","), F.lit(".")).try_cast("double")
    return cut.select(key, decode_entities(F.regexp_extract("tile", 'title="([^"]*)"', 1)).alias("title"), price.alias("price"))
