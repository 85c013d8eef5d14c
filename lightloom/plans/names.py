"""Queries: names, labels and stems, over names that the given tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .registry import query, table

_CONV = r"trim(regexp_replace(regexp_replace(regexp_replace(trim({x}), '\s+', '_', 'g'), '[^0-9A-Za-z_+.\-]', '_', 'g'), '_+', '_', 'g'), '_')"
_EXTR = r"coalesce(nullif(trim(regexp_replace(regexp_replace(replace(replace(replace(trim({x}), 'Gaia DR3 ', 'GaiaDR3_'), 'Gaia DR2 ', 'GaiaDR2_'), 'HD ', 'HD_'), '[^A-Za-z0-9._+-]+', '_', 'g'), '_+', '_', 'g'), '._'), ''), 'unknown')"
_PAGE = "regexp_extract(url, '[^/]+$')"
_STEM = r"'^(s\d{4})_(.+)_(target\d+)_(.+)$'"


@query(f"SELECT p_partkey, {_CONV.format(x="p_name || ' / ' || p_brand")} AS token FROM part")
def file_token_converter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.converter_token(F.concat("p_name", F.lit(" / "), "p_brand")).alias("token"))


@query(f"SELECT p_partkey, {_EXTR.format(x="'HD ' || p_name || ' (' || p_type || ')'")} AS token FROM part")
def file_token_extractor(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.extractor_token(F.concat(F.lit("HD "), "p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("token"))


_NAMED = "CASE p_size % 5 WHEN 0 THEN 'hd ' WHEN 1 THEN 'NAME ' WHEN 2 THEN 'V* ' WHEN 3 THEN '* ' ELSE 'Gaia DR3 ' END || p_name"
_PREFIXES = "|".join(X.CATALOGUE_PREFIXES)


def _named(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 5
    prefix = F.when(kind == 0, "hd ").when(kind == 1, "NAME ").when(kind == 2, "V* ").when(kind == 3, "* ").otherwise("Gaia DR3 ")
    return table(spark, sf, "part").select("p_partkey", F.concat(prefix, F.col("p_name")).alias("name"), "p_brand")


@query(f"SELECT p_partkey, regexp_matches(upper(trim({_NAMED})), '^(?:{_PREFIXES})') AS is_catalogue FROM part")
def catalog_like_name(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("p_partkey", X.is_catalogue_name(F.col("name")).alias("is_catalogue"))


_STRIPPED = rf"regexp_replace(trim({_NAMED}), '(?i)^(?:NAME |\* |V\* |EM\* )', '')"


@query(f"SELECT p_partkey, {_EXTR.format(x=_STRIPPED)} AS label FROM part")
def strip_object_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("p_partkey", X.without_object_prefix(F.col("name")).alias("label"))


_FILE = "CASE page_id % 3 WHEN 0 THEN 'x-s' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || '-' WHEN 1 THEN 's' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') ELSE 'n' END || " + _PAGE


def _files(spark: SparkSession, sf: str) -> DataFrame:
    number = F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0")
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x-s"), number, F.lit("-"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("s"), number)).otherwise("n")
    return table(spark, sf, "pages").select("page_id", F.concat(head, F.regexp_extract("url", "[^/]+$", 0)).alias("file"))


@query(rf"WITH f AS (SELECT page_id, {_FILE} AS file FROM pages), s AS (SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(file, '[-_]s(\d{{4}})[-_]', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(file, 's(\d{{4}})', 1), '') AS INTEGER)) AS sector FROM f) SELECT page_id, sector, coalesce('s' || lpad(CAST(sector AS VARCHAR), 4, '0'), 'nosector') AS tag FROM s")
def sector_from_name(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("int")
    return _files(spark, sf).select("page_id", X.sector_number(none, F.col("file")).alias("sector"), X.sector_tag(none, F.col("file")).alias("tag"))


_S = "'s' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '_' || replace(p_name, ' ', '_') || CASE WHEN p_size % 4 = 0 THEN '' ELSE '_target' || (p_size % 9) END || '_' || p_brand"


def _stems(spark: SparkSession, sf: str) -> DataFrame:
    target = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("_target"), (F.col("p_size") % 9).cast("string")))
    stem = F.concat(F.lit("s"), F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), target, F.lit("_"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", stem.alias("stem"), "p_size", "p_name", "p_brand")


@query(rf"""WITH s AS (SELECT p_partkey, {_S} AS stem FROM part), m AS (SELECT *, regexp_matches(stem, {_STEM}) AS ok FROM s)
SELECT p_partkey, CASE WHEN ok THEN regexp_extract(stem, {_STEM}, 1) END AS sector, CASE WHEN ok THEN regexp_extract(stem, {_STEM}, 2) END AS source,
CASE WHEN ok THEN regexp_replace(stem, {_STEM}, '\2_\3_\4_\1') ELSE stem END AS per_sector, CASE WHEN ok THEN regexp_replace(stem, {_STEM}, '\2_\3_\4') ELSE stem END AS combined FROM m""")
def stem_parse(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.col("stem")
    parts = X.stem_parts(stem)
    return _stems(spark, sf).select("p_partkey", parts["sector"].alias("sector"), parts["source"].alias("source"), X.sector_stem(stem).alias("per_sector"), X.combined_stem(stem).alias("combined"))


@query(f"SELECT p_partkey, 's0007_' || {_EXTR.format(x='p_name')} || '_target' || p_size || '_' || {_EXTR.format(x='p_brand')} AS stem, CASE WHEN p_size % 2 = 0 THEN p_brand || '_x' ELSE 'x' END AS name FROM part")
def output_stem(spark: SparkSession, sf: str) -> DataFrame:
    stem = X.output_stem(F.lit("s0007"), F.col("p_name"), F.col("p_size"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", stem.alias("stem"), X.prefixed_name(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit("x")).alias("name"))


_FRAME = "CASE c_custkey % 3 WHEN 0 THEN c_name || '_IND_nm_pchip_analysis_frame' WHEN 1 THEN c_name || '__IND' ELSE '_' || c_name END"
_CORE = f"trim(regexp_replace({_FRAME}, '(?:_IND_nm_pchip_analysis_frame|_nm_pchip_analysis_frame|_analysis_frame|_IND)$', ''), ' _-')"


@query(rf"SELECT c_custkey, coalesce(nullif(regexp_replace(trim(regexp_replace({_CORE}, '_+', ' ', 'g')), '\s+', ' ', 'g'), ''), 'target') AS display, coalesce(nullif(trim(regexp_replace({_CORE}, '[^A-Za-z0-9.+-]+', '_', 'g'), '_'), ''), 'target') AS safe FROM customer")
def star_label(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("c_custkey") % 3
    stem = F.when(kind == 0, F.concat("c_name", F.lit("_IND_nm_pchip_analysis_frame"))).when(kind == 1, F.concat("c_name", F.lit("__IND"))).otherwise(F.concat(F.lit("_"), "c_name"))
    return table(spark, sf, "customer").select("c_custkey", X.star_labels(stem).alias("s")).select("c_custkey", "s.display", "s.safe")


_RUN = "CASE c_custkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN 'A' WHEN 2 THEN ' 12b ' ELSE substr(c_mktsegment, 1, 3) END"


@query(f"WITH r AS (SELECT c_custkey, nullif(trim({_RUN}), '') AS token FROM customer) SELECT c_custkey, token, CASE WHEN length(token) > 1 AND regexp_matches(token, '[A-Za-z]$') THEN left(token, -1) ELSE token END AS base FROM r")
def run_tokens(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("c_custkey") % 4
    run = F.when(kind == 0, "  ").when(kind == 1, "A").when(kind == 2, " 12b ").otherwise(F.substring("c_mktsegment", 1, 3))
    return table(spark, sf, "customer").select("c_custkey", X.run_token(run).alias("token"), X.base_run_token(run).alias("base"))


_ID = "CASE c_custkey % 4 WHEN 0 THEN 'HIP 1' WHEN 1 THEN '* ' || c_mktsegment WHEN 2 THEN '' ELSE 'TIC 9' END"
_IDS = "CASE c_custkey % 3 WHEN 0 THEN 'TIC 5|HD ' || c_custkey WHEN 1 THEN 'HD 1| NAME ' || c_mktsegment || '|X' ELSE 'Q 1' END"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN {_EXTR.format(x='c_mktsegment')} WHEN c_custkey % 3 = 0 THEN 'HD_' || c_custkey
WHEN c_custkey % 3 = 1 THEN {_EXTR.format(x='c_mktsegment')} ELSE c_name END AS label FROM customer""")
def label_priority(spark: SparkSession, sf: str) -> DataFrame:
    kind, ids = F.col("c_custkey") % 4, F.col("c_custkey") % 3
    main = F.when(kind == 0, "HIP 1").when(kind == 1, F.concat(F.lit("* "), "c_mktsegment")).when(kind == 2, "").otherwise("TIC 9")
    listed = F.when(ids == 0, F.concat(F.lit("TIC 5|HD "), F.col("c_custkey").cast("string"))).when(ids == 1, F.concat(F.lit("HD 1| NAME "), "c_mktsegment", F.lit("|X"))).otherwise("Q 1")
    return table(spark, sf, "customer").select("c_custkey", X.preferred_label(main, listed, F.col("c_name")).alias("label"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS value FROM supplier")
def header_fallback(spark: SparkSession, sf: str) -> DataFrame:
    headers = F.create_map(F.lit("SECTOR"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(""), F.lit("OBJECT"), F.col("s_nationkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", X.header_value(headers, "MISSING", "SECTOR", "OBJECT").alias("value"))
