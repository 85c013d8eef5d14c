"""Names and labels of targets, sectors and files, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalogue prefixes, object-type prefixes and file suffixes that decide about labels.
CATALOGUE_PREFIXES = (
    "GAIA", "HD ", "HIP ", "TYC ", "TIC ", "2MASS ", "UCAC", "WISE ", "BD ", "CD ", "CPD ", "GSC ", "APASS ", "SDSS ",
    "USNO ", "NAME ", "TOI ", "KIC ", "EPIC ", "ASAS ", "GJ ", "IRAS ",
)
OBJECT_PREFIXES = ("NAME ", "* ", "V* ", "EM* ")
FRAME_SUFFIXES = ("_IND_nm_pchip_analysis_frame", "_nm_pchip_analysis_frame", "_analysis_frame", "_IND")


def converter_token(x: Column) -> Column:
    """White space to _, other characters than letters, digits and ``_+-.`` to _, runs of _ to one, none at the ends."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", "_"), r"[^0-9A-Za-z_+\-.]", "_")
    return F.btrim(F.regexp_replace(kept, "_+", "_"), F.lit("_"))


def extractor_token(x: Column) -> Column:
    """Survey prefixes joined, runs of other characters to one _, no ``._`` at the ends, ``unknown`` if nothing is left."""
    joined = F.trim(x)
    for old, new in (("Gaia DR3 ", "GaiaDR3_"), ("Gaia DR2 ", "GaiaDR2_"), ("HD ", "HD_")):
        joined = F.replace(joined, F.lit(old), F.lit(new))
    cleaned = F.btrim(F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9._+-]+", "_"), "_+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unknown"))


def is_catalogue_name(x: Column) -> Column:
    return F.upper(F.trim(x)).rlike("^(?:" + "|".join(CATALOGUE_PREFIXES) + ")")


def without_object_prefix(x: Column) -> Column:
    """One leading object-type prefix gone (any case), then ``extractor_token``."""
    prefix = "|".join(p.replace("*", r"\*") for p in OBJECT_PREFIXES)
    return extractor_token(F.regexp_replace(F.trim(x), f"(?i)^(?:{prefix})", ""))


def sector_number(meta: Column, name: Column) -> Column:
    """From metadata, else the first ``-sNNNN-`` and then the first ``sNNNN`` of a file name."""
    found = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")
    return F.coalesce(meta.cast("int"), found(r"[-_]s(\d{4})[-_]"), found(r"s(\d{4})"))


def sector_tag(meta: Column, name: Column) -> Column:
    sector = sector_number(meta, name)
    return F.when(sector.isNotNull(), F.format_string("s%04d", sector)).otherwise("nosector")


STEM = r"^(s\d{4})_(.+)_(target\d+)_(.+)$"


def stem_parts(stem: Column) -> Column:
    """Struct sector, source, target, method; null where the stem has another form."""
    part = lambda k: F.regexp_extract(stem, STEM, k)
    names = ("sector", "source", "target", "method")
    return F.when(stem.rlike(STEM), F.struct(*[part(k).alias(n) for k, n in enumerate(names, 1)]))


def sector_stem(stem: Column) -> Column:
    p = stem_parts(stem)
    return F.when(p.isNotNull(), F.concat_ws("_", p["source"], p["target"], p["method"], p["sector"])).otherwise(stem)


def combined_stem(stem: Column) -> Column:
    p = stem_parts(stem)
    return F.when(p.isNotNull(), F.concat_ws("_", p["source"], p["target"], p["method"])).otherwise(stem)


def light_curve_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, "^preferred_lc_", "")


def output_stem(tag: Column, source: Column, index: Column, method: Column) -> Column:
    target = F.concat(F.lit("target"), index.cast("string"))
    return F.concat_ws("_", extractor_token(tag), extractor_token(source), target, extractor_token(method))


def prefixed_name(prefix: Column, name: Column) -> Column:
    return F.concat_ws("_", F.nullif(F.trim(prefix), F.lit("")), name)


def star_labels(stem: Column) -> Column:
    """Struct display, safe: the stem without its longest known suffix."""
    known = "|".join(sorted(FRAME_SUFFIXES, key=len, reverse=True))
    core = F.btrim(F.regexp_replace(stem, f"(?:{known})$", ""), F.lit(" _-"))
    display = F.regexp_replace(F.trim(F.regexp_replace(core, "_+", " ")), r"\s+", " ")
    safe = F.btrim(F.regexp_replace(core, "[^A-Za-z0-9.+-]+", "_"), F.lit("_"))
    named = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("target"))
    return F.struct(named(display).alias("display"), named(safe).alias("safe"))


def run_token(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def base_run_token(x: Column) -> Column:
    """A trailing letter goes unless nothing else is left."""
    return F.regexp_replace(run_token(x), r"(?<=.)\p{L}$", "")


def preferred_label(main_id: Column, ids: Column, fallback: Column) -> Column:
    """Clean main id, else the first NAME, HD and GAIA DR3 identifier of a ``|`` list, else the fallback."""
    listed = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), r"\|"), lambda i: F.trim(i)), lambda i: i != "")
    first = lambda p: F.get(F.filter(listed, lambda i: F.upper(i).startswith(p)), 0)
    main = without_object_prefix(main_id)
    clean = (F.trim(main_id) != "") & ~F.lower(main).isin("name", "unknown") & ~is_catalogue_name(main_id)
    return F.coalesce(
        F.when(clean, main),
        F.when(first("NAME ").isNotNull(), extractor_token(F.substring(first("NAME "), 6, 1 << 20))),
        F.when(first("HD ").isNotNull(), extractor_token(first("HD "))),
        F.when(first("GAIA DR3 ").isNotNull(), extractor_token(first("GAIA DR3 "))),
        fallback,
    )


def target_label(friendly: Column, at_header: Column, at_brightest: Column, number: Column, catalogue: Column) -> Column:
    """The label of a lone target: a header name that is no catalogue number, what stands at the header's position, what stands at
    the brightest pixel, TIC_ and the header's number, the brightest catalogue source, else unknown_target."""
    useful = lambda x: F.when(~F.lower(x).isin("", "unknown", "nan", "none"), x)
    name = F.trim(friendly)
    own = F.when((name != "") & ~is_catalogue_name(name), useful(extractor_token(name)))
    found = lambda x: F.when(~x.isin("", "unknown_target"), x)
    tic = F.when(F.trim(number) != "", extractor_token(F.concat(F.lit("TIC_"), F.trim(number))))
    return F.coalesce(own, found(at_header), found(at_brightest), tic, found(catalogue), F.lit("unknown_target"))


def header_value(headers: Column, *keys: str) -> Column:
    """The first key of a MAP<STRING, STRING> whose value is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(headers, F.lit(k)), F.lit("")) for k in keys])
