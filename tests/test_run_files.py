"""Files of runs: each by its own header, rejected rows counted, round trips."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from epochal.operators import policies
from epochal.sources import run_files


def put(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", "/").replace("_csv", ".csv").replace("_json", ".json").replace("_txt", ".txt")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)


def listed(spark, path, **more):
    return run_files.listed(spark, path, **more)


def test_lists_of_files(spark, tmp_path):
    root = put(tmp_path, b_txt="22", a_txt="1", sub__C_txt="333", other_csv="x")
    (tmp_path / ".hidden.txt").write_text("x")
    names = lambda df: sorted(r.file for r in df.collect())
    assert names(listed(spark, root, glob="*.txt")) == ["C.txt", "a.txt", "b.txt"]
    assert {(r.file, r.folder, r.bytes) for r in listed(spark, root, glob="C*").collect()} == {("C.txt", "sub", 3)}
    allow = spark.createDataFrame([(" c.TXT ",), ("b.txt",), ("absent.txt",), ("",), (None,), ("b.txt",)], "file string")
    assert names(listed(spark, root, glob="*.txt", allow=allow)) == ["C.txt", "b.txt"]
    assert names(listed(spark, root, glob="*.txt", most=2)) == ["C.txt", "a.txt"] and names(listed(spark, root, allow=allow.limit(0))) == []


def test_headers_are_each_files_own(spark, tmp_path):
    root = put(tmp_path, a_csv='x, y\n1,"two, 2"\n3,\n', b_csv="y;z\n5;6\n", c_csv="", d_csv="y,x\n8,7\n")
    rows = run_files.headed(listed(spark, root)).select("x", "y", "z", "source_file").collect()
    assert Counter(map(tuple, rows)) == Counter([("1", "two, 2", None, "a.csv"), ("3", None, None, "a.csv"), (None, "5", "6", "b.csv"), ("7", "8", None, "d.csv")])
    bare = listed(spark, put(tmp_path / "bare", n_csv="1818;01;12.5\n1818;02;-1\n"))
    assert [tuple(r)[:3] for r in run_files.headed(bare, ["year", "month", "n"]).orderBy("month").collect()] == [("1818", "01", "12.5"), ("1818", "02", "-1")]
    with pytest.raises(ValueError, match="no header"):
        run_files.headed(bare)
    assert run_files.headed(listed(spark, root, glob="c*")).columns == ["source_file", "source_folder"]
    df = spark.createDataFrame([("1", "2")], "` Phase_Start ` string, delta_a_km string")
    assert df.select(run_files.column(df, "start", "phase_start").alias("a"), run_files.column(df, "delta_a").alias("b"), run_files.column(df, "no", needed=False).alias("c")).first() == ("1", "2", None)
    with pytest.raises(ValueError, match="no column"):
        run_files.column(df, "no")


def test_intervals_with_reasons(spark, tmp_path):
    root = put(
        tmp_path,
        a_csv="sat_name,phase,start,end\nSAT7.txt ,raise,2024-01-01,2024-01-02 12:00:00\nsat8,raise,2024-01-01,2024-01-01\n,raise,2024-01-01,2024-01-02\nsat9,raise,soon,2024-01-02\n",
        b_csv="phase_end,phase_state,sat_id,phase_start\n1970-01-02,hold,x/Sat7_decay.txt,1970-01-01\n",
    )
    rows = run_files.read_intervals(listed(spark, root))
    good = {(r.object, r.phase, r.start, r.end, r.source_file) for r in rows.where("reject IS NULL").collect()}
    day = 86_400_000_000
    assert good == {("sat7", "raise", 19723 * day, 19724 * day + day // 2, "a.csv"), ("sat7", "hold", 0, day, "b.csv")}
    assert {(r.source_file, r.fate): r.n for r in run_files.counts(rows).collect()} == {("a.csv", "accepted"): 1, ("a.csv", "no_length"): 1, ("a.csv", "no_object"): 1, ("a.csv", "no_time"): 1, ("b.csv", "accepted"): 1}


def test_controls(spark, tmp_path):
    phases = {p: {"duty_cycle": k / 4, "mean_thrust_N": 0.1, "mean_isp_s": 1500, "mean_efficiency": 0.5, "more": 1} for k, p in enumerate(("insertion_or_orbit_raise", "operational_shell"))}
    (tmp_path / "c.json").write_text(json.dumps({"fitted_parameters": {"mass_kg": 260, "isp_s": 1600}, "per_phase": phases}, indent=1))
    got = {r.phase: (r.sign, r.duty_cycle, r.mean_isp_s, r.mass_kg, r.eta_total) for r in run_files.read_controls(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"insertion_or_orbit_raise": (1, 0.0, 1500.0, 260.0, None), "operational_shell": (1, 0.25, 1500.0, 260.0, None), "disposal_lowering": (-1, None, None, 260.0, None)}


def test_assignments_policies_and_stats(spark, tmp_path):
    root = put(tmp_path, a_csv="sat_id,global_cluster_id\nS1,2\ns1.txt,2\nS1_decay,3\nS2,x\nS2,\n,4\n")
    got = {r.object: (r.cluster_id, r.votes, r.n_rows) for r in run_files.read_assignments(listed(spark, root)).collect()}
    assert got == {"s1": (2, 2, 3), "s2": (0, 2, 2)}
    root = put(tmp_path / "p", p_csv="cluster_id,policy_delta_a,delta_Omega_rad,cost_scalar\n1,2.5,0.01,3\n0,1,1,1\nx,1,1,1\n2,inf,,\n")
    rows = run_files.read_policies(listed(spark, root))
    assert {(r.cluster_id, r.delta_a, r.delta_Omega, r.tau_keep, r.cost, r.reject) for r in rows.collect()} == {(1, 2.5, 0.01, None, 3.0, None), (0, 1.0, 1.0, None, 1.0, "noise"), (None, 1.0, 1.0, None, 1.0, "no_cluster"), (2, None, None, None, None, None)}
    members = spark.createDataFrame([("s1", 1, 7000.0), ("s9", 2, 7000.0)], "object string, cluster_id long, sma double")
    applied = policies.with_policy(members, rows.where("reject IS NULL")).collect()
    assert {r.object: (r.policy_delta_a, r.policy_tau_keep) for r in applied} == {"s1": (2.5, 86400.0), "s9": (0.0, 86400.0)}
    root = put(tmp_path / "s", s_csv="global_cluster_id,count,sma.mean,name\n1,5,7000.5,a\n1,7,1,b\n,2,x,c\n")
    got = {r.cluster_id: (r["count"], r["sma.mean"]) for r in run_files.read_stats(listed(spark, root)).collect()}
    assert got == {1: (7, 1.0), 0: (2, None)}


def test_labels_by_folder(spark, tmp_path):
    head = "timestamp,sma,cluster_label,umap_1,umap_2\n"
    root = put(tmp_path, labels_53_2__cluster_labels_4_clusters_csv=head + "2024-01-01,7000,1,0.5,x\n2024-01-01,7000,,1,1\n", labels_53_2__cluster_labels_9_clusters_csv=head + "t,1,1,1,1\n", other__cluster_labels_2_clusters_csv="umap_2,umap_1,cluster_label\n2,1,-1\n")
    got = Counter((r.source_folder, r.group_order, r.cluster_label, r.sma, r.umap_1, r.umap_2, r.reject) for r in run_files.read_labels(spark, root).collect())
    assert got == Counter([("labels_53_2", 53.0, 1, 7000.0, 0.5, None, None), ("labels_53_2", 53.0, None, 7000.0, 1.0, 1.0, "no_label"), ("other", None, -1, None, 1.0, 2.0, None)])
    with pytest.raises(ValueError, match="no column absent"):
        run_files.read_labels(spark, root, needed=("absent",))


def test_chains_by_stem(spark, tmp_path):
    root = put(
        tmp_path,
        run1_sat12_posterior_samples_csv="chain,draw,beta_m2_per_kg,bc_kg_per_m2,log_post\n1,5,0.1,10,-3\n0,x,0.2,5,\n",
        run1_sat12_observations_used_csv="t\n1\n", run1_sat12_chain_traces_csv="t\n1\n",
        run2_posterior_samples_csv="beta_m2_per_kg,bc_kg_per_m2,sat_file\n" + "".join(f"{k},1,a/sat77.txt\n" for k in range(6)),
        run3_posterior_samples_csv="bc_kg_per_m2,beta_m2_per_kg\n" + "".join(f"1,{k}\n" for k in range(5)),
        run4_chain_traces_csv="t\n", run5_observations_used_csv="t\n", other_csv="t\n",
    )
    files = listed(spark, root)
    assert {r.stem: r.status for r in run_files.manifest(files).collect()} == {"run1_sat12": "complete", "run2": "posterior_only", "run3": "posterior_only", "run4": "trace_only", "run5": "obs_only"}
    hints = spark.createDataFrame([("run2", 2), ("run3", 2), ("run3", None), ("none", 4)], "stem string, n_chains int")
    got = {}
    for r in run_files.read_posterior(files, hints).collect():
        got.setdefault(r.stem, []).append((r.object, r.chain_id, r.sample_id, r.beta, r.synthetic, r.reject))
    assert sorted(got["run1_sat12"], key=str) == sorted([("sat12", 1, 5, 0.1, False, None), ("sat12", 0, None, 0.2, False, "not_a_number")], key=str)
    assert sorted(got["run2"]) == [("sat77", k // 3, k % 3, float(k), True, None) for k in range(6)]
    assert sorted(got["run3"]) == [("run3", 0, k, float(k), True, None) for k in range(5)]
    assert run_files.read_posterior(files).where("stem = 'run2' AND chain_id <> 0").count() == 0


def test_designators_and_generations(spark, tmp_path):
    rows = [("19074A", "2019-074"), (" 57001 ", "1957-001"), ("56999B", "2056-999"), ("1907", None), ("ab074A", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "d string, want string").withColumn("got", run_files.cospar_root(F.col("d")))
    assert all(r.got == r.want for r in df.collect())
    root = put(tmp_path, l_csv="filename,generation,cospar_root\na.txt ,GEN1,2019-074\nb.txt,gen2,2020-001\n,gen1,2019-074\n")
    labels = run_files.headed(listed(spark, root))
    assert [r.file for r in run_files.chosen(labels, "filename", "gen1").collect()] == ["a.txt"]
    roots = run_files.chosen(labels, "cospar_root", "Gen1", "root")
    kept = df.withColumn("root", F.col("got")).join(roots, "root", "left_semi").collect()
    assert [r.d for r in kept] == ["19074A"]


def test_arcs_go_round(spark, tmp_path):
    arcs = spark.createDataFrame([(1, "s", [0.0, 5.0, 2.0], [7000.0, None, 7001.0]), (2, None, [1.0], [1.0]), (3, "t", [], [])], "arc_id long, sat_id string, dt_s array<double>, a_obs_km array<double>")
    path = str(tmp_path / "arcs")
    run_files.write_arcs(arcs, path)
    assert spark.read.parquet(path).count() == 5
    assert sorted(map(tuple, run_files.read_arcs(spark, path).collect())) == sorted(map(tuple, arcs.collect()))
    run_files.write_arcs(arcs.limit(0), path)
    assert run_files.read_arcs(spark, path).count() == 0


def test_text_of_numbers(spark, tmp_path):
    xs = [0.0, 1.0, -2.5, 1 / 3, 123456789.0, 12345678.4, 1e-4, 9.9999e-5, 1e300, -1e-300, 100.0, 6871.123456789, 0.1 + 0.2, math.inf, -math.inf, None, math.nan, 99999999.6]
    got = [r.s for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(run_files.general(F.col("x")).alias("s")).collect()]
    assert got == [None if x is None or math.isnan(x) else f"{x:.8g}" for x in xs]
    members = spark.createDataFrame([("a", 1, "medoid", 3, 9, 1 / 3), ("b", 0, "noise", 1, 1, None)], "object string, cluster_id long, role string, weight_active long, weight_global long, sma double")
    out = str(tmp_path / "clusters")
    run_files.write_clusters(members.withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")), out)
    read = lambda name: spark.read.csv(f"{out}/{name}", header=True).collect()
    assert {(r.object, r.sma, r.at) for r in read("selection")} == {("a", "0.33333333", "2024-01-02 03:04:05"), ("b", None, "2024-01-02 03:04:05")}
    assert [tuple(r) for r in read("medoids")] == [("1", "a", "3", "9")]
    assert {(r.role, r.n_rows, r.n_clusters, r.members) for r in read("summary")} == {("medoid", "1", "1", "3"), ("noise", "1", "1", "1")}
