import numpy as np
import pytest

from lightloom.sources import light_curves as L


def fits(path, columns, meta=()):
    """A file with an empty first unit and one table."""
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(80)
    pad = lambda b, fill: b + fill * (-len(b) % 2880)
    first = "".join([card("SIMPLE", "T"), card("BITPIX", "8"), card("NAXIS", "0"), *[card(k, v) for k, v in meta], "END".ljust(80)])
    kinds = [(n, a.dtype.newbyteorder(">"), a.shape[1:]) for n, a in columns.items()]
    table = np.zeros(len(next(iter(columns.values()))), kinds)
    for n, a in columns.items():
        table[n] = a
    code = {"f8": "D", "f4": "E", "i4": "J", "i8": "K"}
    fields = []
    for k, (n, a) in enumerate(columns.items(), 1):
        count = int(np.prod(a.shape[1:])) if a.ndim > 1 else 1
        fields += [card(f"TTYPE{k}", f"'{n}'"), card(f"TFORM{k}", f"'{count}{code[a.dtype.str[1:]]}'")]
    head = "".join([card("XTENSION", "'BINTABLE'"), card("BITPIX", "8"), card("NAXIS", "2"), card("NAXIS1", str(table.dtype.itemsize)), card("NAXIS2", str(len(table))), card("TFIELDS", str(len(columns))), *fields, "END".ljust(80)])
    path.write_bytes(pad(first.encode(), b" ") + pad(head.encode(), b" ") + pad(table.tobytes(), b"\0"))


def test_light_curve_files(spark, tmp_path):
    t = np.arange(5.0)
    fits(tmp_path / "a.fits", {"TIME": t, "SAP_FLUX": np.array([1, 2, np.nan, 4, 5], "f4"), "QUALITY": np.array([0, 0, 0, 8, 0], "i4")}, [("SECTOR", "7"), ("OBJECT", "'x 1'")])
    rows = L.ingest_light_curves(spark, str(tmp_path)).orderBy("time_btjd").collect()
    assert [r.sap_flux for r in rows] == [1, 2, None, 4, 5] and rows[3].quality == 8
    assert rows[0].sector == 7 and rows[0].ticid == "x 1" and [r.cadence_num for r in rows] == list(range(5)) and rows[0].pdcsap_flux is None


def test_cubes(spark, tmp_path):
    flux = np.arange(24.0).reshape(2, 12)
    fits(tmp_path / "c.fits", {"TIME": np.arange(2.0), "FLUX": flux, "CADENCENO": np.array([5, 6], "i4")})
    rows = L.ingest_cubes(spark, str(tmp_path)).orderBy("cadence").collect()
    assert [r.cadence for r in rows] == [5, 6] and rows[1].flux == flux[1].tolist() and rows[0].quality == 0


def test_csv_directory(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_btjd,flux_rel,z\n10,1,q\n11,x,q\n12,3,q\n")
    (tmp_path / "b.csv").write_text("time_btjd,flux_detrend_rel\n5,7\n6,nan\n")
    (tmp_path / "c.csv").write_text("other\n1\n")
    series, skipped = L.read_mixed_directory(spark, str(tmp_path))
    got = {(r.series_id.rsplit("/", 1)[1], r.t, r.y) for r in series.collect()}
    raw, _ = L.read_mixed_directory(spark, str(tmp_path), mode="raw")
    assert {r.series_id.rsplit("/", 1)[1] for r in raw.collect()} == {"a.csv"}
    assert got == {("a.csv", 0.0, 1.0), ("a.csv", 2.0, 3.0), ("b.csv", 0.0, 7.0)}
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in skipped.collect()] == [("c.csv", "no time_btjd column")]


def test_polarimetry_orbits_and_sinks(spark, tmp_path):
    (tmp_path / "p.csv").write_text("JD,q,u,p,qe,run\n2450000.5,1,2,3,0.1,A\n2450001.5,4,bad,6,0.2, \n")
    rows = {(r.series_id, r.t): (r.y, r.yerr, r.run_label) for r in L.read_polarimetry(spark, str(tmp_path / "p.csv"), "run").collect()}
    assert rows["q", 0.0] == (1, 0.1, "A") and rows["q", 1.0] == (4, 0.2, None) and ("u", 1.0) not in rows and len(rows) == 5
    (tmp_path / "o.csv").write_text(" sector , mid_tjd, freq_cyc/day \n1, 2.5, 0.07\nx,1,1\n2,nan,1\n")
    assert [tuple(r) for r in L.read_orbit_table(spark, str(tmp_path / "o.csv")).collect()] == [(1, 2.5, 0.07)]
    df = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("b", 1.0)], "series_id string, t double")
    L.write_series(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.count() == 3 and set(back.columns) == {"series_id", "t"}
    assert [r.series_id for r in L.unfinished(df, back.filter("series_id = 'a'")).collect()] == ["b"]


def test_products_sidecars_and_combined_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("jd,q,u,p,q_nm,u_nm,p_nm\n1,1,2,3,10,20,30\n2,1,2,3,11,21,31\n")
    (tmp_path / "r.csv").write_text("jd,q,u,p\n5,1,2,3\n5.1,3,2,5\n")
    ready = {(r.series_id, r.t): r.y for r in L.read_polarimetry(spark, str(tmp_path / "p.csv"), product="nm").collect()}
    assert ready["q", 0.0] == 10 and ready["p", 1.0] == 31 and len(ready) == 6
    made = {(r.series_id, round(r.t, 3)): round(r.y, 6) for r in L.read_polarimetry(spark, str(tmp_path / "r.csv"), product="nm").collect()}
    assert made == {("q", 0.0): -1, ("q", 0.1): 1, ("u", 0.0): 0, ("u", 0.1): 0, ("p", 0.0): -1, ("p", 0.1): 1}
    np.save(tmp_path / "a_x.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert [(r.row, r["values"]) for r in L.read_sidecars(spark, str(tmp_path)).orderBy("row").collect()] == [(0, [1, 2]), (1, [3, 4])]
    df = spark.createDataFrame([("a", 2.0, 1), ("b", 1.0, 2), ("a", 1.0, 3)], "target string, t double, v int")
    L.write_combined(df, str(tmp_path / "all"))
    files = list((tmp_path / "all").glob("target=a/*.csv"))
    assert len(files) == 1 and files[0].read_text().split() == ["t,v", "1.0,3", "2.0,1"]
    L.write_table(df, str(tmp_path / "table"))
    assert spark.read.csv(str(tmp_path / "table"), header=True).count() == 3


def test_columns_by_each_files_own_header(spark, tmp_path):
    """Files that order their columns otherwise, or have other ones, give the values under their own names."""
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    (a / "1.csv").write_text("jd,q,u,p\n1,10,20,30\n")
    (a / "2.csv").write_text("jd,p,u,q,q_err\n1,30,20,10,0.5\n")
    got = {(r.series_id, r.file.rsplit("/", 1)[1]): (r.y, r.yerr) for r in L.read_polarimetry(spark, str(a)).collect()}
    assert got == {(c, f): (v, 0.5 if (c, f) == ("q", "2.csv") else None) for c, v in (("q", 10), ("u", 20), ("p", 30)) for f in ("1.csv", "2.csv")}
    (b / "1.csv").write_text("time_btjd,flux_rel\n10,1\n11,2\n")
    (b / "2.csv").write_text('﻿"flux_rel", time_btjd\r\n1,10\r\n2,11\r\n\r\n')
    (b / "3.csv").write_text("time_btjd,flux_medscaled,flux_leveled_rel\n10,8,1\n11,9,2\n")
    got = {(r.series_id.rsplit("/", 1)[1], r.t, r.t_abs, r.y) for r in L.read_csv_series(spark, str(b)).collect()}
    assert got == {(f"{k}.csv", t, t + 10, t + 1) for k in (1, 2, 3) for t in (0.0, 1.0)}
    got = L.read_csv_series(spark, [str(b / "3.csv")], forced="flux_medscaled").collect()
    assert {(r.y, r.column) for r in got} == {(8, "flux_medscaled"), (9, "flux_medscaled")}
    with pytest.raises(ValueError, match="flux_medscaled.*1.csv|flux_medscaled.*2.csv"):
        L.read_csv_series(spark, str(b), forced="flux_medscaled")
    (a / "3.csv").write_text("jd,q,u\n1,10,20\n")
    with pytest.raises(ValueError, match="missing columns: p in 1 file.*3.csv"):
        L.read_polarimetry(spark, str(a))


def test_raw_and_product_files_in_one_directory(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("p,u,q,jd\n3,1,1,5\n5,3,3,5.1\n")
    (tmp_path / "made.csv").write_text("jd,q,u,p,u_nm,q_nm,p_nm\n1,1,2,3,20,10,30\n")
    got = {(r.file.rsplit("/", 1)[1], r.series_id, round(r.t, 3)): round(r.y, 6) for r in L.read_polarimetry(spark, str(tmp_path), product="nm").collect()}
    made = {("made.csv", c, 0.0): v for c, v in (("q", 10), ("u", 20), ("p", 30))}
    assert got == made | {("raw.csv", c, t): v for c in "qup" for t, v in ((0.0, -1), (0.1, 1))}


def test_sidecars_go_with_their_file(spark):
    files = spark.createDataFrame([("x",), ("y",)], "stem string")
    sidecars = spark.createDataFrame([("bkg", "x", "b/x_2.npy"), ("bkg", "x", "a/x_1.npy"), ("cen", "x", "c.npy")], "prefix string, stem string, path string")
    got = {(r.stem, r.prefix, r.path) for r in L.diagnostics_for(files, sidecars).collect()}
    assert got == {("x", "bkg", "a/x_1.npy"), ("x", "cen", "c.npy"), ("y", None, None)}


def test_batches_survive_a_kill_between_data_and_marker(spark, tmp_path, monkeypatch):
    """A run that stops between its data and its marker leaves nothing that counts; the next one writes every key once."""
    path = str(tmp_path / "out")
    inputs = spark.createDataFrame([(s, float(k)) for k, s in enumerate("aabbcd")], "series_id string, y double")
    seen = []

    def work(part):
        seen.append({r.series_id for r in part.collect()})
        return part.filter("series_id != 'd'").withColumn("z", part.y * 2)

    with pytest.raises(FileNotFoundError):
        L.read_batches(spark, path)
    first = inputs.filter("series_id = 'a'")
    assert {tuple(r) for r in L.write_batch(first, work, path).collect()} == {("a", 2)}
    writer = type(inputs.write)
    real = writer.parquet

    def killed(self, to, *a, **k):
        if "/done/" in to:
            raise KeyboardInterrupt
        return real(self, to, *a, **k)

    monkeypatch.setattr(writer, "parquet", killed)
    with pytest.raises(KeyboardInterrupt):
        L.write_batch(inputs, work, path)
    monkeypatch.setattr(writer, "parquet", real)
    assert {r.series_id for r in L.read_batches(spark, path).collect()} == {"a"}
    done = {tuple(r) for r in L.write_batch(inputs, work, path).collect()}
    assert done == {("a", 2), ("b", 2), ("c", 1)} and seen == [{"a"}, {"b", "c", "d"}, {"b", "c", "d"}]
    assert sorted(r.y for r in L.read_batches(spark, path).collect()) == [0, 1, 2, 3, 4]
    L.write_batch(inputs, work, path)
    assert seen[-1] == {"d"}  # a key without rows is not marked


def test_files_are_found_once_and_results_are_skipped(spark, tmp_path):
    below = tmp_path / "below"
    below.mkdir()
    for n in ("a_tp.fits", "b_tpf.fits.gz", "c_astrocut.fits", "d.fits", "e_tp.txt", "below/f_tp.fits"):
        (tmp_path / n).write_text("x")
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert names(L.find_files(spark, str(tmp_path))) == ["a_tp.fits", "b_tpf.fits.gz", "c_astrocut.fits"]
    assert names(L.find_files(spark, [str(tmp_path), str(below)], recursive=True)) == ["a_tp.fits", "b_tpf.fits.gz", "c_astrocut.fits", "f_tp.fits"]
    assert names(L.find_files(spark, str(tmp_path), single=str(tmp_path / "d.fits"))) == ["d.fits"]
    for n in ("one", "detrended_two", "three_detrend", "four"):
        (below / f"{n}.csv").write_text("flux_medscaled,flux_rel,time_btjd\n7,1,10\n" if n != "four" else "flux_rel\n1\n")
    rows, skipped = L.read_for_detrending(spark, str(below))
    assert [(r.series_id.rsplit("/", 1)[1], r.y, r.column) for r in rows.collect()] == [("one.csv", 1, "flux_rel")]
    got = {r.file.rsplit("/", 1)[1]: r.reason for r in skipped.collect()}
    assert got == {"detrended_two.csv": "already detrended", "three_detrend.csv": "already detrended", "four.csv": "no time_btjd column"}


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"series_id={k}").mkdir()
        (tmp_path / f"series_id={k}" / "a.csv").write_text(f"time_btjd,flux_rel\n0,{k}\n1,2\n")
    spark.sparkContext.setJobGroup("listing", "listing")
    rows, skipped = L.read_mixed_directory(spark, str(tmp_path))
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    most = 4 * spark.sparkContext.defaultParallelism
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= most < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert rows.count() == 120 and skipped.count() == 0
