"""JSON readers with tolerant shapes and fixed schemas, and writers that refuse bad results.

A reader takes every spelling of a field that sources use, gives each row one schema, keeps tri-state flags
nullable, and drops rows without a key.  Spellings are data: (our name, type, spellings in order).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Spec = list[tuple[str, str, list[str]]]

#: Fields of each table and their spellings in order (fixed values).
OFFER: Spec = [
    ("id", "string", ["id", "code", "barcode", "url"]),
    ("source", "string", ["source"]),
    ("source_label", "string", ["sourceLabel"]),
    ("name", "string", ["name", "product_name"]),
    ("brand", "string", ["brand"]),
    ("brand_source", "string", ["brandSource"]),
    ("category", "string", ["category"]),
    ("price", "double", ["price"]),
    ("currency", "string", ["currency"]),
    ("price_note", "string", ["priceNote"]),
    ("image", "string", ["image"]),
    ("url", "string", ["url"]),
    ("barcode", "string", ["barcode"]),
    ("barcode_source", "string", ["barcodeSource"]),
    ("match_key", "string", ["matchKey"]),
    ("local", "boolean", ["isLocalBrand", "local"]),
    ("local_evidence", "string", ["localEvidence"]),
    ("quantity", "string", ["quantity"]),
    ("quantity_source", "string", ["quantitySource"]),
]
PRODUCT: Spec = [
    ("code", "string", ["code", "barcode", "id"]),
    ("name", "string", ["name", "product_name"]),
    ("brand", "string", ["brand", "brands"]),
    ("image", "string", ["image", "image_url"]),
    ("tags", "array<string>", ["categoriesTags", "categories_tags"]),
]
STORE: Spec = [
    ("chain", "string", ["chain"]),
    ("name", "string", ["name"]),
    ("city", "string", ["city"]),
    ("address", "string", ["address"]),
    ("phone", "string", ["phone"]),
    ("hours", "string", ["hours"]),
    ("url", "string", ["url"]),
    ("source", "string", ["source"]),
    ("kind", "string", ["storeType"]),
    ("lat", "double", ["lat", "latitude"]),
    ("lng", "double", ["lng", "lon", "longitude"]),
    ("groceries", "boolean", ["sellsGroceries"]),
]
PAIRING: Spec = [
    ("brand", "string", ["brand", "flaggedBrand"]),
    ("company", "string", ["company"]),
    ("category", "string", ["category"]),
    ("tags", "array<string>", ["tags", "categoryTags"]),
    ("verified", "boolean", ["verified"]),
    ("source_url", "string", ["sourceUrl"]),
    ("alternatives", "array<struct<brand:string,company:string,country:string,evidence:string>>", ["alternatives"]),
]
NOTE: Spec = [("name", "string", ["name", "store"]), ("note", "string", ["note", "text"]), ("url", "string", ["url"])]
ORIGIN: Spec = [
    ("brand", "string", ["brand", "name"]),
    ("code", "string", ["code", "barcode"]),
    ("made_in", "string", ["productionCountry", "country"]),
    ("company", "string", ["company"]),
    ("owner", "string", ["ownership", "owner"]),
    ("owner_country", "string", ["ownershipCountry"]),
    ("verified", "boolean", ["verified"]),
    ("source_url", "string", ["sourceUrl"]),
]
LISTED: Spec = [("brand", "string", ["brand", "name"]), ("aliases", "array<string>", ["aliases"]), ("country", "string", ["country"]), ("category", "string", ["category"]), ("code", "string", ["code", "barcode"])]
ATTRIBUTE: Spec = [("iso", "string", ["iso", "isoCode", "code"]), ("name", "string", ["name", "country"]), ("recognises", "boolean", ["recognises", "recognizes"]), ("sources", "array<string>", ["sources"])]
#: Where a range's first and last number may stand, in order; a single number is both (fixed values).
RANGE_FIRST = ["range", "rangeStart", "rangeEnd", "prefixStart", "prefixEnd", "from", "to", "prefix", "code"]
RANGE_LAST = ["range", "rangeEnd", "rangeStart", "prefixEnd", "prefixStart", "to", "from", "prefix", "code"]
ISSUER: Spec = [("issuer", "string", ["country", "countryName", "name", "issuingCountry", "iso"]), ("kind", "string", ["kind"]), ("iso", "string", ["iso", "isoCode", "cc"])]


class Unreadable(ValueError):
    """A table that is not there or holds no rows in any known shape."""


def field(raw: Column, kind: str, spellings: list[str]) -> Column:
    """The first spelling with a value, trimmed, cast where it can be; blanks are missing."""
    found = F.coalesce(*(F.nullif(F.trim(F.get_json_object(raw, f"$.{s}")), F.lit("")) for s in spellings))
    if kind.startswith("array"):
        return F.from_json(found, kind)
    return found if kind == "string" else F.when(found.isin("true", "false"), found == "true") if kind == "boolean" else found.try_cast(kind)


def rows_of(spark: SparkSession, path: str, *under: str) -> DataFrame:
    """(raw): one JSON object a row, from lines, or from one document: an array, or an object that has it under the first of some keys.

    Raises ``Unreadable`` where there is no such file, and for a document without rows in any of these shapes.
    """
    try:
        lines = spark.read.text(path, wholetext=bool(under))
    except AnalysisException as e:
        raise Unreadable(path) from e
    if not under:
        return lines.select(F.col("value").alias("raw"))
    inner = F.coalesce(*(F.get_json_object("value", f"$.{u}") for u in under), F.when(F.trim("value").startswith("["), F.col("value")))
    rows = lines.select(F.from_json(inner, "array<string>").alias("rows"))
    if rows.where("rows IS NOT NULL").isEmpty():
        raise Unreadable(path)
    return rows.select(F.explode("rows").alias("raw"))


def keyed_rows(spark: SparkSession, path: str, *under: str) -> DataFrame:
    """(key, raw): one row an entry of an object, the whole document or under the first of some keys."""
    lines = spark.read.text(path, wholetext=True)
    inner = F.coalesce(*(F.get_json_object("value", f"$.{u}") for u in under), F.col("value"))
    return lines.select(F.explode(F.from_json(inner, "map<string,string>")).alias("key", "raw"))


def rows_or_none(spark: SparkSession, path: str, spec: Spec, key: str, *under: str) -> DataFrame:
    """The table, or an empty one of the same schema where it can't be read: a missing list must not stop the rest."""
    try:
        raw = rows_of(spark, path, *under)
    except Unreadable:
        raw = spark.createDataFrame([], "raw string")
    return normalise(raw, spec, key)


def normalise(raw: DataFrame, spec: Spec, key: str) -> DataFrame:
    """The fields of ``spec``; rows without ``key`` go, unknown fields too."""
    return raw.select(*(field(F.col("raw"), kind, names).alias(name) for name, kind, names in spec)).where(F.col(key).isNotNull())


def tag_index(keyed: DataFrame) -> DataFrame:
    """(tag, n, code) of an inverted index ``{tag: {count, codes}}``; a count that is missing is that of the codes."""
    codes = F.from_json(F.get_json_object("raw", "$.codes"), "array<string>")
    return keyed.select(F.col("key").alias("tag"), F.coalesce(F.get_json_object("raw", "$.count").try_cast("bigint"), F.size(codes).cast("bigint")).alias("n"), F.explode(codes).alias("code"))


def attributes(keyed: DataFrame, listed: DataFrame) -> DataFrame:
    """Country attributes, from an object by code and from rows that name theirs: codes in capitals, first row of each."""
    own = normalise(keyed.select(F.to_json(F.map_concat(F.create_map(F.lit("iso"), "key"), F.from_json("raw", "map<string,string>"))).alias("raw")), [f if f[0] != "sources" else ("sources", "string", ["sources"]) for f in ATTRIBUTE], "iso")
    rows = own.withColumn("sources", F.from_json("sources", "array<string>")).unionByName(normalise(listed, ATTRIBUTE, "iso")).withColumn("iso", F.upper("iso"))
    return rows.groupBy("iso").agg(F.min_by(F.struct("name", "recognises", "sources"), F.struct(F.col("name").isNull(), "name")).alias("r")).select("iso", "r.*")


def ranges(raw: DataFrame) -> DataFrame:
    """(lo, hi, issuer, kind, iso) of issuer ranges in any of their spellings; swapped bounds are put right."""
    numbers = lambda names: F.coalesce(*(F.nullif(F.regexp_extract_all(F.get_json_object("raw", f"$.{n}"), F.lit("([0-9]+)")), F.array().cast("array<string>")) for n in names))
    first, last = F.get(numbers(RANGE_FIRST), F.lit(0)).try_cast("int"), F.element_at(numbers(RANGE_LAST), -1).try_cast("int")
    rows = raw.select(F.least(first, last).alias("lo"), F.greatest(first, last).alias("hi"), *(field(F.col("raw"), kind, names).alias(name) for name, kind, names in ISSUER))
    rows = rows.withColumns({"issuer": F.coalesce("issuer", F.lit("Unknown")), "kind": F.coalesce("kind", F.lit("country"))})
    return rows.withColumn("iso", F.when(F.col("kind") == "country", F.col("iso"))).where("lo IS NOT NULL AND hi IS NOT NULL")


def unblocked(rows: DataFrame, patterns: list[str], columns: list[str]) -> DataFrame:
    """Rows of which no column matches a blocked-source pattern, letter case aside."""
    blocked = F.lit(False)
    for p in patterns:
        blocked = blocked | F.concat_ws(" ", *columns).rlike(f"(?i){p}")
    return rows.where(~blocked)


def write_if_kept(rows: DataFrame, path: str, before: int, share: float) -> int:
    """Writes Parquet unless fewer than ``share`` of ``before`` rows are left; returns the rows written."""
    n = rows.count()
    if n == 0 or n < share * before:
        raise ValueError(f"refusing to write {n} rows where there were {before}")
    rows.write.mode("overwrite").parquet(path)
    return n
