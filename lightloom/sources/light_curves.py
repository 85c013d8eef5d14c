"""Light curves, polarimetry, orbit tables and diagnostics from files; results to files.

Files are listed and read by Spark's readers (globs, recursion and several paths are reader options); what a reader cannot
parse is decoded by one task per file.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.waves import finite

# Names under which columns come, in order of preference.
FLUX_COLUMNS = ("flux_detrend_rel", "flux_leveled_rel", "flux_rel", "flux_detrended_rel", "flux_medscaled")
RAW_COLUMNS = ("flux_rel", "flux_detrended_rel")
DETRENDED_COLUMNS = ("flux_detrend_rel", "flux_decor_only_rel", "flux_rel", "flux_detrended_rel")
SEARCH_COLUMNS = ("flux_detrend_rel", "flux_detrended_sub", "flux_detrended_div", "flux_detrended_rel", "flux_medscaled", "flux_rel")
FLUX_MODES = {"raw": RAW_COLUMNS, "detrended": DETRENDED_COLUMNS, "auto": DETRENDED_COLUMNS + RAW_COLUMNS + SEARCH_COLUMNS}
#: Endings of the columns of a polarimetric product, after the channel's letter.
PRODUCTS = {"nm": "_nm", "resid_nm_pchip": "_resid_nm_pchip", "pw_resid_nm_pchip": "_pw_resid_nm_pchip"}
POLARIMETRY_ALIASES = {
    "jd": ("jd", "JD"), "q": ("q",), "u": ("u",), "p": ("p",), "q_err": ("q_err", "qe"), "u_err": ("u_err", "ue"), "p_err": ("p_err", "pe"),
}
DETREND_COLUMNS = ("flux_rel", "flux_detrended_rel", "flux_medscaled")
CUBE_NAMES = ("*tp.fits", "*tpf.fits", "*tp.fits.gz", "*tpf.fits.gz", "*_astrocut.fits", "*_astrocut.fits.gz")
CUBE_PATTERNS = "{*.fits,*.fits.gz,*.fit,*.fit.gz,*.fts,*.fts.gz}"
LIGHT_CURVE = (
    "file string, ticid string, sector int, time_btjd double, sap_flux double, sap_flux_err double, pdcsap_flux double, "
    "pdcsap_flux_err double, quality int, cadence_num long"
)


def first_column(df: DataFrame, names: tuple[str, ...], forced: str | None = None) -> str:
    """The forced column, else the first candidate that exists; decided from the schema."""
    if forced is not None:
        names = (forced,)
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of the columns {', '.join(names)} in {', '.join(df.columns)}")


def few_listings(spark: SparkSession) -> None:
    """Many folders are listed by a few tasks with many each, instead of a task each."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))


def _file_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines: file, k, cells; headers: file, header) of CSV files, each with its own header line: columns are found by their name in
    the file they stand in, so files may order or choose them as they like. Neither files nor their lists pass through the driver;
    files are split like any text. Values with commas or line ends are not expected."""
    few_listings(spark)
    reader = spark.read.option("recursiveFileLookup", recursive)
    lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    clean = lambda c: F.transform(F.split(c, ","), lambda x: F.btrim(F.btrim(x), F.lit('"')))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"), F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    first = F.struct("block", "k")
    headers = lines.groupBy("file").agg(F.min(first)["k"].alias("at"), clean(F.min_by("value", first)).alias("header"))
    rows = lines.join(headers, "file").filter(F.col("k") != F.col("at")).filter(F.btrim("value") != "")
    return rows.select("file", "header", "k", clean(F.col("value")).alias("cells")), headers.drop("at")


def _text_cell(name: str | Column) -> Column:
    """A line's value under a name of its file's header; null without such a column."""
    at = F.array_position("header", name if isinstance(name, Column) else F.lit(name)).cast("int")
    return F.when(at > 0, F.try_element_at("cells", F.nullif(at, F.lit(0))))


def _cell(name: str | Column) -> Column:
    return finite(_text_cell(name).try_cast("double"))


def _first_named(names: tuple[str, ...]) -> Column:
    """The first of ``names`` that a file's header has."""
    return F.coalesce(*[F.when(F.array_contains("header", n), F.lit(n)) for n in dict.fromkeys(names)])


def _demand(headers: DataFrame, missing: Column, what: str) -> None:
    """An error that names a file without what is needed; one row comes to the driver."""
    bad = headers.filter(missing).agg(F.min(F.struct("file", "header")).alias("m"), F.count("*").alias("n")).first()
    if bad.n:
        raise ValueError(f"{what} in {bad.n} file(s), {bad.m.file} for one, which has {', '.join(bad.m.header)}")


def find_files(spark: SparkSession, path: str | list[str], patterns: tuple[str, ...] = CUBE_NAMES, recursive: bool = False, single: str | None = None) -> DataFrame:
    """(path) of the files of any of the patterns, each once, whatever patterns or folders name it twice; ``single``, one file, is
    taken instead. Files are listed by Spark, none is read."""
    reader = spark.read.format("binaryFile")
    if single is None:
        reader = reader.option("pathGlobFilter", "{" + ",".join(patterns) + "}").option("recursiveFileLookup", recursive)
    return reader.load(single if single is not None else path).select("path").distinct()


def read_for_detrending(spark: SparkSession, path: str, prefix: str = "detrended_", pattern: str = "*.csv", recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(series, skipped) as ``read_mixed_directory`` gives them, by the columns that a detrending starts from. Files that are results of
    one already, by their name (``prefix`` at the beginning, or _detrend in it), are skipped."""
    rows, skipped = read_mixed_directory(spark, path, DETREND_COLUMNS, pattern, recursive)
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    done = lambda c: stem(F.col(c)).startswith(prefix) | stem(F.col(c)).contains("_detrend")
    again = rows.filter(done("series_id")).select(F.col("series_id").alias("file")).distinct().withColumn("reason", F.lit("already detrended"))
    return rows.filter(~done("series_id")), skipped.unionByName(again)


def read_csv_series(spark: SparkSession, path: str | list[str], candidates: tuple[str, ...] = FLUX_COLUMNS, forced: str | None = None, time: str = "time_btjd") -> DataFrame:
    """(series_id: file, t, t_abs, y, k, column) of all files at once; time relative to each file's first. Each file's flux is the
    forced column or the first candidate of its own header; a file without one, or without times, is an error."""
    from ..operators.series import by

    rows, headers = _file_lines(spark, path)
    column = _first_named((forced,) if forced else candidates)
    _demand(headers, ~F.array_contains("header", time), f"no column {time}")
    _demand(headers, column.isNull(), f"none of the columns {', '.join((forced,) if forced else candidates)}")
    told = rows.select(F.col("file").alias("series_id"), _cell(time).alias("t_abs"), _cell(column).alias("y"), "k", column.alias("column"))
    told = told.filter("t_abs is not null and y is not null")
    return told.select("series_id", (F.col("t_abs") - F.min("t_abs").over(by())).alias("t"), "t_abs", "y", "k", "column")


def _number(name: str) -> Column:
    return finite(F.expr(f"try_cast(`{name}` as double)"))


def read_mixed_directory(spark: SparkSession, path: str, candidates: tuple[str, ...] | None = None, pattern: str = "*.csv", recursive: bool = True, mode: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(series: series_id (the file), t, t_abs, y, k, column; skipped: file, reason) of all files of a directory, whatever columns each
    has. ``mode`` is raw, detrended or auto, unless ``candidates`` are given."""
    from ..operators.series import by

    rows, headers = _file_lines(spark, path, pattern, recursive)
    column = _first_named(candidates or FLUX_MODES[mode])
    reason = F.when(~F.array_contains("header", "time_btjd"), "no time_btjd column").when(column.isNull(), "no flux column")
    told = rows.filter(reason.isNull()).select(F.col("file").alias("series_id"), _cell("time_btjd").alias("t_abs"), _cell(column).alias("y"), "k", column.alias("column"))
    series = told.filter("t_abs is not null and y is not null")
    headers = headers.withColumn("reason", reason)
    empty = headers.filter("reason is null").select("file").join(series.select(F.col("series_id").alias("file")).distinct(), "file", "left_anti")
    skipped = headers.filter("reason is not null").select("file", "reason").unionByName(empty.withColumn("reason", F.lit("no finite rows after cleaning")))
    return series.select("series_id", (F.col("t_abs") - F.min("t_abs").over(by())).alias("t"), "t_abs", "y", "k", "column"), skipped


def read_polarimetry(spark: SparkSession, path: str, run_label: str | None = None, product: str | None = None) -> DataFrame:
    """Channels as rows: series_id (channel), file, jd, t (from the file's first jd), y, yerr, run_label, k. Each file's own header
    says what it has: with ``product`` y is that product's column where a file has it, and files without it must be raw ones, of
    which the product is built; both kinds may stand in one directory."""
    rows, headers = _file_lines(spark, path)
    ending = PRODUCTS[product] if product else ""
    ready = F.lit(True)
    for c in "qup":
        ready = ready & F.array_contains("header", f"{c}{ending}")
    for n in ("jd", "q", "u", "p"):
        wanted = _first_named(POLARIMETRY_ALIASES[n])
        _demand(headers, (wanted.isNull() if n == "jd" else ~ready & wanted.isNull()), f"missing columns: {n}")
    label = F.nullif(F.trim(_text_cell(run_label)), F.lit("")) if run_label else F.lit(None).cast("string")
    number = lambda n: _cell(_first_named(POLARIMETRY_ALIASES[n]))
    value = lambda c: F.when(ready, _cell(f"{c}{ending}")).otherwise(number(c))
    channel = lambda c: F.struct(F.lit(c).alias("series_id"), value(c).alias("y"), number(f"{c}_err").alias("yerr"))
    wide = rows.select("file", number("jd").alias("jd"), label.alias("run_label"), "k", ready.alias("ready"), F.array(*map(channel, "qup")).alias("channels"))
    first = F.min("jd").over(Window.partitionBy("file"))
    long = wide.select("file", "jd", (F.col("jd") - first).alias("t"), "run_label", "k", "ready", F.inline("channels"))
    long = long.filter("jd is not null and y is not null")
    if product is None or headers.filter(~ready).isEmpty():
        return long.drop("ready")
    made = _with_product(long.filter(~F.col("ready")).drop("ready"), product)
    return long.filter("ready").drop("ready").unionByName(made)


def _with_product(channels: DataFrame, product: str) -> DataFrame:
    from ..operators.products import polarimetric_frame

    key = F.concat_ws("|", "series_id", "file")
    frame = polarimetric_frame(channels.select(key.alias("series_id"), "t", "y", "k"))
    column = {"nm": "nm", "resid_nm_pchip": "resid", "pw_resid_nm_pchip": "prewhitened"}[product]
    made = frame.select(F.col("series_id").alias("key_"), F.col("k").alias("k_"), F.col(column).alias("made_"))
    joined = channels.join(made, (key == F.col("key_")) & (F.col("k") == F.col("k_")))
    return joined.withColumn("y", F.col("made_")).select(*channels.columns)


def read_orbit_table(spark: SparkSession, path: str) -> DataFrame:
    """(sector, mid_tjd, frequency): header names stripped, rows with another sector than a whole number dropped."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    rows = raw.select(F.expr("try_cast(sector as int)").alias("sector"), _number("mid_tjd").alias("mid_tjd"), _number("freq_cyc/day").alias("frequency"))
    return rows.dropna()


def diagnostics_for(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Of several sidecar files of one (prefix, stem) the lexicographically first."""
    first = diagnostics.groupBy("prefix", "stem").agg(F.min("path").alias("path"))
    return files.join(first, "stem", "left")


def read_sidecars(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """(file, row, values) of arrays saved by numpy, one task a file; a one-dimensional array has one value a row."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, raw in zip(files["path"], files["content"], strict=True):
                rows = np.load(io.BytesIO(bytes(raw)), allow_pickle=False)
                rows = rows.astype(float).reshape(len(rows), -1) if rows.ndim else rows.astype(float).reshape(1, 1)
                yield pd.DataFrame({"file": name, "row": np.arange(len(rows)), "values": rows.tolist()})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(decode, "file string, row long, values array<double>")


def _cards(block: bytes) -> dict[str, str]:
    out = {}
    for i in range(0, len(block), 80):
        card = block[i : i + 80].decode("ascii", "replace")
        if card[8:10] == "= ":
            value = card[10:].split("/")[0].strip()
            out[card[:8].strip()] = value.strip("'").strip()
    return out


def _tables(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and data of every unit of a file of 2880-byte records."""
    at = 0
    while at < len(raw):
        head = b""
        while b"END" + b" " * 77 not in [head[i : i + 80] for i in range(0, len(head), 80)]:
            head += raw[at : at + 2880]
            at += 2880
            if at > len(raw) + 2880:
                return
        cards = _cards(head)
        size = abs(int(cards.get("BITPIX", 8))) // 8 * int(np.prod([int(cards[f"NAXIS{k}"]) for k in range(1, int(cards.get("NAXIS", 0)) + 1)])) if int(cards.get("NAXIS", 0)) else 0
        yield cards, raw[at : at + size]
        at += -(-size // 2880) * 2880


_FORMATS = {"E": ">f4", "D": ">f8", "J": ">i4", "K": ">i8", "I": ">i2", "B": "u1", "L": "S1"}


def _columns(cards: dict[str, str], data: bytes) -> dict[str, np.ndarray]:
    kinds = []
    for k in range(1, int(cards["TFIELDS"]) + 1):
        form = cards[f"TFORM{k}"]
        count, code = int(form[:-1] or 1), form[-1]
        kind = f"S{count}" if code == "A" else _FORMATS[code]
        kinds.append((cards[f"TTYPE{k}"].upper(), kind) if count == 1 or code == "A" else (cards[f"TTYPE{k}"].upper(), kind, (count,)))
    table = np.frombuffer(data, np.dtype(kinds), count=int(cards["NAXIS2"]))
    return {n: table[n] for n in table.dtype.names}


def ingest_light_curves(spark: SparkSession, path: str) -> DataFrame:
    """Light-curve tables (the first extension of each file) as rows of ``LIGHT_CURVE``; missing columns get defaults."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, raw in zip(files["path"], files["content"], strict=True):
                units = list(_tables(bytes(raw)))[:2]
                (first, _), (head, data) = units[0], units[1]
                cols = _columns(head, data)
                n = len(cols["TIME"])
                value = lambda k, fill, kind: np.asarray(cols[k], kind) if k in cols else np.full(n, fill, kind)  # noqa: B023, E731
                meta = lambda *keys: next((h[k] for h in (first, head) for k in keys if h.get(k)), None)  # noqa: B023, E731
                sector = meta("SECTOR")
                yield pd.DataFrame({
                    "file": name, "ticid": meta("TICID", "TARGETID", "OBJECT"), "sector": None if sector is None else int(sector), "time_btjd": value("TIME", np.nan, float),
                    "sap_flux": value("SAP_FLUX", np.nan, float), "sap_flux_err": value("SAP_FLUX_ERR", np.nan, float), "pdcsap_flux": value("PDCSAP_FLUX", np.nan, float),
                    "pdcsap_flux_err": value("PDCSAP_FLUX_ERR", np.nan, float), "quality": value("QUALITY", 0, np.int32),
                    "cadence_num": np.asarray(cols["CADENCENO"], np.int64) if "CADENCENO" in cols else np.arange(n),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", CUBE_PATTERNS).option("recursiveFileLookup", True).load(path)
    rows = files.select("path", "content").mapInPandas(decode, LIGHT_CURVE)
    fluxes = ("time_btjd", "sap_flux", "sap_flux_err", "pdcsap_flux", "pdcsap_flux_err")
    return rows.withColumns({c: finite(F.col(c)) for c in fluxes})


def ingest_cubes(spark: SparkSession, path: str) -> DataFrame:
    """Pixel cubes as (stamp_id: file, cadence, time, quality, flux: the frame row by row); FLUX needs two axes a row."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, raw in zip(files["path"], files["content"], strict=True):
                head, data = list(_tables(bytes(raw)))[1]
                cols = _columns(head, data)
                if cols["FLUX"].ndim != 2:
                    raise ValueError(f"FLUX is no cube in {name}")
                n = len(cols["TIME"])
                pick = lambda *keys: next((np.asarray(cols[k], np.int64) for k in keys if k in cols), None)  # noqa: B023, E731
                quality, cadence = pick("QUALITY", "DQUALITY"), pick("CADENCENO", "CADENCE")
                yield pd.DataFrame({"stamp_id": name, "cadence": np.arange(n) if cadence is None else cadence, "time": np.asarray(cols["TIME"], float), "quality": np.zeros(n, np.int64) if quality is None else quality, "flux": [f.astype(float).tolist() for f in cols["FLUX"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", CUBE_PATTERNS).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(decode, "stamp_id string, cadence long, time double, quality long, flux array<double>")


def write_series(series: DataFrame, path: str, key: str = "series_id", time: str = "t", kind: str = "csv") -> None:
    """One folder a series, sorted by time. Rows go to tasks by series and time range, so a long series is many files."""
    ranged = series.repartitionByRange(F.col(key), F.col(time)).sortWithinPartitions(key, time)
    writer = ranged.write.partitionBy(key).mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def write_combined(series: DataFrame, path: str, key: str = "target", time: str = "t") -> None:
    """One CSV file a key, sorted by time: all rows of a key are written by one task, so a key must be what one file can hold."""
    series.repartition(F.col(key)).sortWithinPartitions(key, time).write.partitionBy(key).mode("overwrite").option("header", True).csv(path)


def write_table(table: DataFrame, path: str, kind: str = "csv") -> None:
    """A result table (modes, peaks, summary)."""
    writer = table.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)


def unfinished(inputs: DataFrame, done: DataFrame, key: str = "series_id") -> DataFrame:
    """Inputs whose key the sink does not hold yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _batches(spark: SparkSession, path: str) -> list[str]:
    """The batches whose marker is complete."""
    if not _exists(spark, f"{path}/done"):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    names = [x.getPath().getName() for x in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]
    return sorted(n for n in names if _exists(spark, f"{path}/done/{n}/_SUCCESS"))


def finished(spark: SparkSession, path: str, kind: str, key: str = "series_id") -> DataFrame:
    """(key, rows) of the keys that ``write_batch`` has finished under ``path``; kind: the key's type."""
    schema = f"{key} {kind}, rows long"
    paths = [f"{path}/done/{n}" for n in _batches(spark, path)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_batch(inputs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str = "series_id") -> DataFrame:
    """Does ``work`` for the keys of ``inputs`` that are not finished under ``path``, and tells which are now: (key, rows).

    Results go to a folder of their own first; the marker, one row for each key that gave rows, is written after them and names
    the folder. Readers (``read_batches``) see marked folders only, so a run that is stopped between both, or in either, leaves
    nothing that counts, and the next one does its keys again. A key without rows is never marked."""
    spark, name = inputs.sparkSession, f"batch-{uuid.uuid4().hex}"
    done = finished(spark, path, inputs.schema[key].dataType.simpleString(), key)
    left = unfinished(inputs, done, key)
    if left.isEmpty():
        return done
    work(left).write.parquet(f"{path}/data/{name}")
    rows = spark.read.parquet(f"{path}/data/{name}").groupBy(key).agg(F.count("*").alias("rows"))
    rows.write.parquet(f"{path}/done/{name}")
    return finished(spark, path, inputs.schema[key].dataType.simpleString(), key)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The results of all finished batches under ``path``."""
    names = _batches(spark, path)
    if not names:
        raise FileNotFoundError(f"nothing is finished under {path}")
    return spark.read.parquet(*[f"{path}/data/{n}" for n in names])
