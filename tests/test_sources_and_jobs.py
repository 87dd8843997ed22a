import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agronimbus.operators import schema as S
from agronimbus.operators import suitability
from agronimbus.operators.aggregates import daily_resample
from agronimbus.operators.planning import recommend_starts
from agronimbus.operators.suitability import compare_crops, match_sequence, nested_comparisons, predict_viability
from agronimbus.plans import jobs, storage
from agronimbus.sources import payloads, readers, selection, sinks

D = dt.date


def day(n):
    return D(2026, 5, 1) + dt.timedelta(days=n - 1)


def test_daily_payload(rows):
    body = {"properties": {"parameter": {
        "T2M": {"20260501": 31.1, "20260502": -999.0}, "T2M_MIN": {"20260501": 28.0}, "T2M_MAX": {"20260501": 35.0},
        "PRECTOTCORR": {"20260501": 2.37, "20260502": 0.0}, "RH2M": {"20260502": 60.0}, "OTHER": {"20260501": 1.0}}}}
    df = rows([("s", json.dumps(body)), ("t", "{}"), ("u", "broken")], "site string, body string")
    out = payloads.parameter_map_to_daily(df, ["site"]).orderBy("date").collect()
    assert [tuple(r) for r in out] == [
        ("s", day(1), 31.1, 28.0, 35.0, 2.37, None), ("s", day(2), -999.0, None, None, 0.0, 60.0),
    ]


def test_forecast_payload_defaults_and_daily_values(rows):
    item = lambda h, main, rain=None: {"dt_txt": f"2026-05-01 {h}:00:00", "main": main, **({"rain": rain} if rain else {})}
    body = {"list": [
        item("00", {"temp": 10, "temp_min": 8, "temp_max": 12, "humidity": 50}, {"3h": 1.5}),
        item("03", {"temp": 20}), {"dt_txt": "2026-05-02 00:00:00"}]}
    three = payloads.forecast_list_to_rows(rows([("s", json.dumps(body))], "site string, body string"), ["site"])
    got = [tuple(r)[1:] for r in three.orderBy("date", "temp").collect()]
    assert got == [(day(1), 10.0, 8.0, 12.0, 1.5, 50.0), (day(1), 20.0, 15.0, 25.0, 0.0, 60.0), (day(2), 20.0, 15.0, 25.0, 0.0, 60.0)]
    daily = daily_resample(three, ["site"], "date").orderBy("date").first()
    assert tuple(daily)[2:] == (15.0, 8.0, 25.0, 1.5, 55.0)


def test_summary_payload(rows):
    out = payloads.summary_text(rows([('{"extract": "90 days"}',), ("{}",)], "body string"))
    assert [r.extract for r in out.collect()] == ["90 days", ""]


def test_source_choice_and_top_up(rows):
    df = rows(
        [("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 3.0), ("b", 1, None), ("b", 1, None), ("b", 3, 5.0), ("b", 3, None), ("c", 1, 1.0)],
        "site string, priority int, temp double",
    )
    out = selection.arbitrate(df, ["site"], "priority", ["temp"]).collect()
    assert sorted((r.site, r.priority) for r in out) == [("a", 2), ("a", 2), ("b", 3), ("b", 3)]
    first = rows([("a", day(1), 1.0), ("a", day(2), 1.0)], "site string, date date, temp double")
    rest = rows([("a", day(d), 9.0) for d in range(1, 8)], "site string, date date, temp double")
    topped = selection.top_up(first, rest, ["site"], "date", 4).orderBy("date").collect()
    assert [(r.date, r.temp) for r in topped] == [(day(1), 1.0), (day(2), 1.0), (day(3), 9.0), (day(4), 9.0)]


def test_equality_filter_with_null_and_without_conditions(rows):
    df = rows([("a", None), ("a", 1), ("b", None)], "k string, n int")
    assert selection.equality_filter(df, {"k": "a", "n": None}).count() == 1
    assert selection.equality_filter(df, {}).count() == selection.equality_filter(df).count() == 3


def test_history_csv_in_both_layouts(spark, tmp_path):
    (tmp_path / "ext.csv").write_text("N,P,K,temperature,humidity,ph,rainfall,label,row_no\n1,2,3,20.5,80,6.5,200,Rice,1\n1,2,3,bad,70,6.1,100, rice ,2\n")
    h = readers.read_history(spark, str(tmp_path / "ext.csv"), ["row_no"], failures=False).orderBy("row_no").collect()
    assert [(r.crop, r.temp, r.rainfall, r.soil_ph, r.result, r.date) for r in h] == [
        ("rice", 20.5, 200.0, 6.5, 1, D(2025, 1, 1)), ("rice", None, 100.0, 6.1, 1, D(2025, 1, 1)),
    ]
    assert 2 <= h[0].temp - h[0].min_temp <= 5
    both = readers.read_history(spark, str(tmp_path / "ext.csv"), ["row_no"])
    assert both.filter("result = 0").count() == 2
    (tmp_path / "bad.csv").write_text("temperature,humidity,rainfall,ph,label,row_no\n20,50,-999,6,rice,1\n-999,50,3,6,rice,2\n")
    cleaned = readers.read_history(spark, str(tmp_path / "bad.csv"), ["row_no"]).orderBy("temp").collect()
    assert [(r.temp, r.rainfall) for r in cleaned] == [(None, 3.0), (5.0, 9.0), (20.0, None), (35.0, 0.0)]
    (tmp_path / "local.csv").write_text("row_no,date,crop,temp,min_temp,max_temp,rainfall,humidity,result\n1,2026-05-01,Wheat,20,15,25,1,60,0\n")
    local = readers.read_history(spark, str(tmp_path / "local.csv"), ["row_no"], failures=False).first()
    assert (local.date, local.crop, local.min_temp, local.result) == (day(1), "wheat", 15.0, 0)


def test_files_of_several_headers_are_read_by_name(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_text("temp,rainfall\n1.0,2.0\n")
    (tmp_path / "b.csv").write_text('\ufeffrainfall,temp,"note, long"\n21.0,10.0,"x, ""y"""\n')
    (tmp_path / "crop=rice").mkdir()
    (tmp_path / "crop=rice" / "c.csv.gz").write_bytes(gzip.compress(b"temp\n5.0\n"))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_SUCCESS").write_text("no table")
    found = readers.read_csv(spark, str(tmp_path)).collect()
    assert sorted((r.temp, r.rainfall, r["note, long"], r.crop) for r in found) == [
        ("1.0", "2.0", None, None), ("10.0", "21.0", 'x, "y"', None), ("5.0", None, None, "rice"),
    ]
    kinds = T.StructType([T.StructField("rainfall", T.DoubleType()), T.StructField("temp", T.DoubleType()), T.StructField("ph", T.DoubleType())])
    typed = readers.read_csv(spark, str(tmp_path / "*.csv"), kinds)
    assert typed.schema == kinds and sorted(map(tuple, typed.collect())) == [(2.0, 1.0, None), (21.0, 10.0, None)]
    assert len(readers.header_groups(spark, str(tmp_path))) == 3
    assert readers.read_csv(spark, str(tmp_path / "empty.csv"), kinds).collect() == []
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))


EXPORT = [("Rice", 92.4, 95.0, "low"), ("Millet", 81.2, 78.0, "medium"), ("Maize", 74.1, 65.0, "medium")]


def test_exports_have_title_headers_and_read_back(spark, rows, tmp_path):
    df = rows(EXPORT, "crop string, similarity_score double, success_probability double, risk_level string")
    nested = df.withColumn("optimal_weather", F.struct(F.lit(1.5).alias("temp")))
    path = sinks.export_similarity_results(nested, str(tmp_path))
    back = spark.read.options(header=True, escape='"').csv(path)
    assert back.columns == ["Crop", "Similarity Score", "Success Probability", "Risk Level", "Optimal Weather"]
    assert json.loads(back.first()["Optimal Weather"]) == {"temp": 1.5}
    daily = df.withColumn("date", F.lit("2026-05-01"))
    read = readers.read_predictions(spark, sinks.export_future_predictions(daily, str(tmp_path)))
    assert read.filter("date = date'2026-05-01' and similarity_score > 80").count() == 2


def test_runs_are_appended_and_found(spark, rows, tmp_path):
    path = str(tmp_path / "runs")
    for crop in ("rice", "wheat", "rice"):
        sinks.append_runs(rows([(crop, 92.4)], "target_crop string, score double"), path)
    assert sinks.read_runs(spark, path, {"target_crop": "rice"}).count() == 2
    every = sinks.read_runs(spark, path).collect()
    assert len({r._id for r in every}) == 3 and all(r.timestamp and r.run_date for r in every)


def test_scratch_folder_is_the_one_the_cluster_names(spark):
    assert storage.shared_folder(spark) == storage.shared_folder(spark)
    df = spark.range(3).selectExpr("id", "array(id) as a")
    kept = storage.materialise(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 3


def test_scratch_tables_are_gone_after_the_session(tmp_path):
    import subprocess
    import sys

    code = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
from agronimbus.plans import storage
a, b = storage.materialise(spark.range(3)), storage.materialise(spark.range(4))
storage.release(a)
import os
own = os.path.join(sys.argv[1], spark.sparkContext.applicationId)
assert b.count() == 4 and len([x for x in os.listdir(own) if x[0] != "."]) == 1, os.listdir(own)
if len(sys.argv) > 2:
    spark.stop()
"""
    for more in ([], ["stop"]):
        done = subprocess.run([sys.executable, "-c", code, str(tmp_path), *more], capture_output=True, text=True, timeout=200,
                              cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        assert done.returncode == 0, done.stderr[-2000:]
        assert [f for _, _, names in os.walk(tmp_path) for f in names] == []


def test_cleanup_drops_the_tables_of_a_session(spark):
    kept = storage.materialise(spark.range(3))
    place = kept._agronimbus_path.removeprefix("file:")
    assert os.path.isdir(place)
    storage.release(kept)
    assert not os.path.isdir(place)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})
            self.sparkContext = type("Context", (), {"master": master})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session("yarn"))
    assert storage.shared_folder(Session("yarn", spark_checkpoint_dir="hdfs://x/y/")) == "hdfs://x/y"
    local = Session("local[2]")
    assert storage.shared_folder(local) == storage.shared_folder(local)


@pytest.fixture(scope="module")
def plains(spark):
    h = [(i, D(2025, 1, 1) + dt.timedelta(days=i % 60), c, 15.0 + i % 17 + s, 10.0 + i % 17 + s, 22.0 + i % 17 + s,
          float(i % 9) * s / 3, 40.0 + i % 31 + s, 6.0 + (i % 5) / 10, int(i % 4 > 0))
         for s, c in ((0, "wheat"), (5, "rice"), (9, "maize")) for i in range(s * 1000, s * 1000 + 60)]
    history = spark.createDataFrame(h, "hist_id long, date date, crop string, temp double, min_temp double, max_temp double, rainfall double, humidity double, soil_ph double, result int")
    f = [("s1" if i < 40 else "s2", day(i % 40 + 1), 18.0 + i % 7, 12.0 + i % 7, 25.0 + i % 7, float(i % 5), 50.0 + i % 11) for i in range(80)]
    forecast = spark.createDataFrame(f, "site_id string, date date, temp double, min_temp double, max_temp double, rainfall double, humidity double")
    return history, forecast


def test_batch_run_exports_and_logs(spark, plains, tmp_path):
    history, forecast = plains
    one = forecast.filter("site_id = 's1'").drop("site_id")
    out = jobs.batch_calculation(history, one, target_crop="wheat", folder=str(tmp_path))
    assert out["matches"].count() == 200 and out["daily_predictions"].count() == 40
    assert [r.crop for r in out["crop_comparisons"].orderBy("rank").collect()].__len__() == 3
    pairs = spark.read.option("header", True).csv(str(tmp_path / "matched_crop_patterns"))
    assert pairs.count() == 40 and pairs.columns[:3] == ["Forecast Date", "Crop", "Forecast Temp"]
    assert {r.Crop for r in pairs.collect()} == {"wheat"}
    run = sinks.read_runs(spark, str(tmp_path / "similarity_analysis_runs"), {"target_crop": "wheat"}).first()
    assert len(run.daily_forecast_summary) == 40 and len(run.crops_comparisons) == 3


def test_requests_as_a_table(spark, plains):
    history, forecast = plains
    asked = spark.createDataFrame(
        [("r1", "s1", "Wheat", day(1), 10), ("r2", "s2", "rice ", day(3), None), ("r3", "s1", "kale", None, 5)],
        "request_id string, site_id string, crop string, start_date date, duration int",
    )
    out = jobs.similarity_requests(history, forecast, asked)
    compared = out["crop_comparisons"].collect()
    assert len(compared) == 9
    plan = {r.request_id: r["count"] for r in out["schedule"].groupBy("request_id").count().collect()}
    assert plan == {"r1": 10, "r2": 38, "r3": 5}
    assert {r.request_id for r in out["scaled_pairs"].collect()} == {"r1", "r2"}
    days = predict_viability(history, forecast, "hist_id", ["site_id", "date"]).collect()
    risk = {(r.site_id, r.date): (r.similarity_score, r.risk_level) for r in days}
    site = {"r1": "s1", "r2": "s2", "r3": "s1"}
    for r in out["schedule"].collect():
        assert (r.similarity_score, r.risk_level) == risk[site[r.request_id], r.date]
    nested = {r.request_id: r for r in jobs.response_records(out).collect()}
    assert [d.day for d in nested["r1"].schedule] == list(range(1, 11))
    assert [c["rank"] for c in nested["r3"].crop_comparisons] == [1, 2, 3] and nested["r3"].scaled_pairs is None


def test_requests_take_one_search_and_agree_with_single_ones(spark, plains, monkeypatch):
    history, forecast = plains
    asked = spark.createDataFrame(
        [("r1", "s1", "wheat", day(1), 10), ("r2", "s2", "rice", day(3), 9)],
        "request_id string, site_id string, crop string, start_date date, duration int",
    )
    calls, search = [], suitability.knn_join
    monkeypatch.setattr(suitability, "knn_join", lambda *a, **b: calls.append(1) or search(*a, **b))
    out = jobs.similarity_requests(history, forecast, asked)
    assert len(calls) == 1
    span = F.datediff("date", "start_date").between(0, F.col("duration") - 1)
    days = asked.join(forecast, "site_id").filter(span)
    wanted = {
        "crop_comparisons": compare_crops(history, days.drop("crop"), "hist_id", ["request_id"]),
        "match_sequence": match_sequence(history, days, "hist_id", ["request_id"]),
        "recommendations": recommend_starts(history, forecast, asked, "hist_id"),
    }
    for name, single in wanted.items():
        assert sorted(out[name].columns) == sorted(single.columns)
        order = sorted(single.columns)
        assert sorted(map(str, out[name].select(order).collect())) == sorted(map(str, single.select(order).collect())), name


def test_comparisons_in_nested_form_can_be_exported(spark, plains, tmp_path):
    history, forecast = plains
    flat = compare_crops(history, forecast, "hist_id", ["site_id"])
    sequence = match_sequence(history, forecast, "hist_id", ["site_id"])
    nested = nested_comparisons(flat, sequence, ["site_id", "crop"], ["temp", "humidity", "rainfall"])
    for r in nested.collect():
        assert len(r.historical_match_sequence) == 40 and r.optimal_weather.temp > 0
        assert [d.date for d in r.historical_match_sequence] == [day(n) for n in range(1, 41)]
    back = spark.read.option("header", True).option("escape", '"').csv(sinks.export_similarity_results(nested, str(tmp_path)))
    assert len(json.loads(back.first()["Historical Match Sequence"])) == 40


def test_advice_fills_in_defaults(spark, plains):
    history, forecast = plains
    asked = spark.createDataFrame([("r1", "s1", "Maize", None, None, None), ("r2", "s2", "millet", 6.2, 7, None)],
                                  "request_id string, site_id string, crop string, soil_ph double, forecast_days int, land_area double")
    out = jobs.planting_advice(history, forecast, asked).collect()
    answered = sorted((r.request_id, r.crop) for r in out if r.status == "answered")
    assert answered == [(r, c) for r in ("r1", "r2") for c in ("maize", "rice", "wheat")]
    assert {(r.request_id, r.crop) for r in out if r.status == "no_history"} == {("r1", "millet"), ("r2", "millet")}
    assert {r.recommended for r in out} <= {"yes", "no", "alternative option like this"}


def test_what_cannot_be_answered_is_told(spark, plains):
    history, forecast = plains
    asked = spark.createDataFrame(
        [("r1", "s1", "Wheat", day(1)), ("r2", "nowhere", "rice", day(3)), ("r3", "s1", "kale", day(1)), ("r4", "s2", "rice", day(35))],
        "request_id string, site_id string, crop string, start_date date",
    )
    lengths = spark.createDataFrame([("wheat", 12), ("Rice", 20), ("kale", 0)], "crop string, growth_duration int")
    out = jobs.similarity_requests(history, forecast, asked, durations=lengths)
    assert {r.request_id: (r.status, r.n_days, r.duration) for r in out["status"].collect()} == {
        "r1": ("answered", 12, 12), "r2": ("no_forecast", 0, 20), "r3": ("no_history", 40, 100), "r4": ("partial", 6, 20),
    }
    records = {r.request_id: r for r in jobs.response_records(out).collect()}
    assert set(records) == {"r1", "r2", "r3", "r4"} and records["r2"].crop_comparisons is None
    advice = jobs.planting_advice(history, forecast, asked.withColumns({"soil_ph": F.lit(6.0), "forecast_days": F.lit(5)}), crops=["rice"]).collect()
    told = {(r.request_id, r.crop): (r.status, r.recommended) for r in advice}
    assert told[("r2", "rice")] == ("no_forecast", "no") and told[("r3", "kale")] == ("no_history", "no")
    assert told[("r1", "wheat")][0] == "answered" and len(told) == 6


def test_a_crop_without_readings_of_a_measure_stays(spark, plains):
    history, forecast = plains
    empty = history.filter("crop = 'rice'").withColumns({c: F.lit(None).cast("double") for c in ("humidity",)})
    both = history.filter("crop <> 'rice'").unionByName(empty)
    out = {r.crop: r for r in compare_crops(both, forecast, "hist_id", ["site_id"]).filter("site_id = 's1'").collect()}
    assert set(out) == {"wheat", "rice", "maize"} and out["rice"].optimal_humidity is None and out["rice"].optimal_temp > 0


def test_candidates_can_be_a_table(spark, plains):
    history, forecast = plains
    pairs = spark.createDataFrame([("s1", "wheat"), ("s2", "rice"), ("s2", "wheat"), ("s2", "wheat")], "site_id string, crop string")
    out = compare_crops(history, forecast, "hist_id", ["site_id"], crops=pairs).collect()
    assert sorted((r.site_id, r.crop) for r in out) == [("s1", "wheat"), ("s2", "rice"), ("s2", "wheat")]
    days = match_sequence(history, forecast, "hist_id", ["site_id"], crops=pairs)
    assert days.groupBy("site_id", "crop").count().filter("count <> 40").count() == 0
    matched = days.join(history.select(F.col("hist_id"), F.col("temp").alias("t"), F.col("date").alias("d")), "hist_id")
    assert matched.filter("matched_temp <> t or matched_date <> d").count() == 0


def test_season_tables_share_schema_and_dates(spark, plains, tmp_path):
    history, forecast = plains
    raw = history.select("hist_id", "crop", "temp", "rainfall", "humidity", "soil_ph")
    weather = forecast.filter("site_id = 's1'").drop("site_id").withColumn("crop", F.lit("wheat"))
    weather = weather.unionByName(weather.withColumn("crop", F.lit("rice")).filter(F.col("date") < day(11)))
    starts = raw.select("crop").distinct().filter("crop <> 'maize'").withColumn("start_date", F.lit(day(1)))
    lengths = spark.createDataFrame([("wheat", 30), ("rice", 75)], "crop string, growth_duration int")
    crop, seen = jobs.season_etl(raw, weather, starts, ["hist_id"], lengths)
    S.require_same_schema(crop, seen)
    want = {("rice", 75, day(1), day(75)), ("wheat", 30, day(1), day(30))}
    for df in (crop, seen):
        got = df.groupBy("crop").agg(F.count("*"), F.min("date"), F.max("date")).collect()
        assert {tuple(r) for r in got} == want
        assert df.filter(" or ".join(f"{c} is null" for c in df.columns)).count() == 0
        assert df.filter("min_temp > temp or temp > max_temp").count() == 0
    sinks.write_season(crop, seen, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "crop_data")).count() == 105
    sinks.write_season(crop, seen, str(tmp_path / "text"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "text" / "weather_data")).count() == 105
    # Only the crops given are replaced.
    sinks.write_season(crop.filter("crop = 'rice'").limit(5), seen.filter("crop = 'rice'").limit(4), str(tmp_path))
    again = spark.read.parquet(str(tmp_path / "crop_data"))
    assert {(r.crop, r["count"]) for r in again.groupBy("crop").count().collect()} == {("wheat", 30), ("rice", 5)}
    with pytest.raises(ValueError):
        sinks.write_season(crop, seen.drop("soil_ph"), str(tmp_path))


def test_a_crop_is_written_to_few_files_and_read_as_one_scan(spark, rows, tmp_path, monkeypatch):
    days = rows([(c, f"2024-01-{d:02d}", float(d)) for c in ("a b", "7", None) for d in range(1, 29)], "crop string, date string, temp double")
    sinks.write_season(days, days, str(tmp_path), "csv")
    assert sorted(len(list(x.glob("*.csv"))) for x in (tmp_path / "weather_data").glob("crop=*")) == [1, 1, 1]
    monkeypatch.setattr(readers, "header_groups", None)  # no list of files on the driver
    back = readers.read_csv(spark, str(tmp_path / "weather_data"))
    assert sorted(map(tuple, back.select("crop", "date", "temp").collect()), key=str) == sorted(((c, d, str(t)) for c, d, t in days.collect()), key=str)
    monkeypatch.setattr(sinks, "FILE_ROWS", 7)
    sinks.write_season(days, days, str(tmp_path / "large"), "csv")
    assert readers.read_csv(spark, str(tmp_path / "large" / "crop_data")).count() == 84
    assert 3 < len(list((tmp_path / "large" / "crop_data").rglob("*.csv"))) <= 12


def test_folders_of_other_headers_or_depths_are_read_by_lists_of_files(spark, rows, tmp_path):
    for name, text in (("x/a.csv", "p,q\n1,2\n"), ("y/k=3/b.csv", "p,q\n3,4\n"), ("z/a.csv", "p,q\n5,6\n"), ("z/b.csv", "q\n7\n"), ("z/_c.csv", "r\n8\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert readers._only_header(spark, str(tmp_path)) is None
    assert readers._only_header(spark, str(tmp_path / "x")) == readers._only_header(spark, str(tmp_path / "y")) == "p,q"
    assert readers._only_header(spark, str(tmp_path / "z")) is None
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "y")).select("p", "q", "k").collect()] == [("3", "4", 3)]


def test_season_files_are_those_of_sparks_writer(spark, rows, tmp_path):
    crops = ["a b", "7", None, "", "x=1/2%", "é'\"", "wheat", "[q]^{r}:*?\\#"]
    texts = ["plain", "", None, " lead ", 'q"uo"te', "com,ma", "new\nline", "back\\slash", "\t", "-"]
    days = rows([(c, t, None if t == "-" else len(t or "") / 3, day(i + 1), i % 2 == 0) for c in crops for i, t in enumerate(texts)], "crop string, `no te` string, temp double, date date, ok boolean")
    days = days.withColumns({"at": F.to_timestamp("date"), "price": F.col("temp").cast("decimal(9,3)")})
    sinks.write_season(days, days, str(tmp_path / "now"), "csv")
    days.repartition(1).write.partitionBy("crop").options(header=True, escape='"').csv(str(tmp_path / "then"))

    def files(folder):
        return {x.name: [sorted(y.read_bytes().split(b"\n")) for y in x.glob("*.csv")] for x in folder.glob("crop=*")}

    for name in ("crop_data", "weather_data"):
        now, then = files(tmp_path / "now" / name), files(tmp_path / "then")
        assert set(now) == set(then) and len(now) == 7  # no value and an empty one share a folder
        shared = "crop=__HIVE_DEFAULT_PARTITION__"
        cells = lambda found: sorted(x for file in found for x in file if x and not x.startswith(b"no te,"))
        assert cells(now.pop(shared)) == cells(then.pop(shared)) and now == then
        # Hadoop's file system, which starts processes for each file, would have made sums.
        assert not list((tmp_path / "now").rglob("*.crc")) and not list((tmp_path / "now").rglob(".staging*"))


def test_season_files_of_the_crops_given_are_replaced(spark, rows, tmp_path):
    days = rows([(c, f"2024-01-{d:02d}", float(d)) for c in ("a", "b", None) for d in range(1, 9)], "crop string, date string, temp double")
    sinks.write_season(days, days, str(tmp_path), "csv")
    old = tmp_path / "crop_data" / "crop=a" / "deeper"
    old.mkdir()
    (old / "part.csv").write_text("date,temp\n1,2\n")
    few = days.filter("crop = 'a' or crop is null").filter("temp < 3")
    sinks.write_season(few, few, str(tmp_path), "csv")
    kinds = T.StructType([T.StructField(n, T.StringType()) for n in ("crop", "date", "temp")])
    back = readers.read_csv(spark, str(tmp_path / "crop_data"), kinds).groupBy("crop").count()
    assert {tuple(r) for r in back.collect()} == {("a", 2), ("b", 8), (None, 2)}
    none = days.filter("temp > 99")
    sinks.write_season(none, none, str(tmp_path / "none"), "csv")
    assert readers.read_csv(spark, str(tmp_path / "none" / "crop_data"), kinds).collect() == []


ODD_LINES = "id,note, v,d\r\n1,a,1.5,2024-01-02\n\n2,\"x, \"\"y\"\"\",bad,2024-13-01\r3,short\n4,long,4,2024-01-04,more\n , ,,\n5,é,5,"


def test_folders_by_key_are_read_as_sparks_reader_reads_them(spark, tmp_path, monkeypatch):
    kinds = T.StructType([T.StructField(n, t) for n, t in (("crop", T.StringType()), ("id", T.IntegerType()), ("v", T.DoubleType()), ("d", T.DateType()), ("note", T.StringType()), ("other", T.LongType()))])
    for name, crops, scanned in (("text", ["a%3Db", "7", "007", "__HIVE_DEFAULT_PARTITION__"], False), ("whole", ["7", "-12", "0"], False), ("padded", ["007", "8"], True), ("split", ["1.50", "2"], True), ("times", ["2024-01-02", "T3"], True)):
        for i, crop in enumerate(crops):
            folder = tmp_path / name / f"crop={crop}" / f"year={i}"
            folder.mkdir(parents=True)
            (folder / "a.csv").write_text(ODD_LINES, newline="")
            (folder / "empty.csv").write_text("")
            (folder / "_b.csv").write_text("x\n1\n")
        (tmp_path / name / "_SUCCESS").write_text("")
        now = readers.read_csv(spark, str(tmp_path / name), kinds)
        # A file scan costs Spark 2 ms a file, and its driver a list of all files.
        assert ("FileScan csv" in now._jdf.queryExecution().toString()) == scanned, name
        with monkeypatch.context() as m:
            m.setattr(readers.local_files, "local_path", lambda *x: None)
            then = readers.read_csv(spark, str(tmp_path / name), kinds)
        assert "FileScan csv" in then._jdf.queryExecution().toString() and now.schema == then.schema
        found = sorted(map(tuple, now.collect()), key=str)
        assert found == sorted(map(tuple, then.collect()), key=str) and len(found) == 6 * len(crops)


def test_files_read_by_workers_are_cut_into_batches(spark, tmp_path, monkeypatch):
    for k in (1, 2):
        (tmp_path / f"k={k}").mkdir()
        for i in range(3):
            (tmp_path / f"k={k}" / f"{i}.csv").write_text("p,q\n" + "".join(f"{j},{'z' * j}\n" for j in range(100)))
    kinds = T.StructType([T.StructField("k", T.StringType()), T.StructField("p", T.IntegerType()), T.StructField("q", T.StringType())])
    monkeypatch.setattr(readers.local_files, "BATCH_LINES", 7)
    found = readers.read_csv(spark, str(tmp_path), kinds).collect()
    assert sorted(map(tuple, found)) == sorted((k, j, "z" * j if j else None) for k in "12" for j in range(100) for _ in range(3))
    monkeypatch.setattr(readers.local_files, "LARGEST", 99)  # a large file is one that Spark splits
    assert "FileScan csv" in readers.read_csv(spark, str(tmp_path), kinds)._jdf.queryExecution().toString()
