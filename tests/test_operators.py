"""Rules of preparation, matching, sources, reports and the tool registry on small fixtures."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace import registry
from millrace.functions import columns as C
from millrace.functions import names as N
from millrace.operators import analysis, anomaly, charts, integrate, ml, prepare, report, search, sql, trends
from millrace.operators.profile import profile
from millrace.sources import files
from millrace.store import SessionStore


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def column(df, c):
    return [r[c] for r in df.collect()]


def test_names():
    assert C.unique_names(["Customer ID ", "customerId", "Total($)", "address.city", "2024 sales", "%%"]) == ["customer_id", "customer_id_2", "total", "address_city", "c_2024_sales", "column"]
    assert [C.table_name(x) for x in ("Order Items (2).csv", "2024.csv", "!!.csv")] == ["order_items_2", "t_2024", "dataset"]
    assert N.similarity("cust_id", "customer_id") == 1.0 and N.similarity("customer_customer_id", "customer_id") == 1.0
    assert N.similarity("price", "city") < 0.5 and N.type_agreement("numeric", "boolean") == 0.7


def test_texts(spark):
    df = frame(spark, "i int, t string", list(enumerate([" N/A ", "unknown", "-", "--", "?", "\\n", "none", "0", None])))
    assert column(df.select(C.null_like(F.col("t")).alias("t")), "t") == [None] * 7 + ["0", None]
    assert column(frame(spark, "t string", [("  a   b ",)]).select(C.strip_whitespace(F.col("t")).alias("t")), "t") == ["a b"]
    n = frame(spark, "t string", [(x,) for x in ("$1,234.50", "45%", "(120)", " 7 ", "x", "1-2", "1e3")])
    assert column(n.select(C.to_numeric(F.col("t")).alias("v")), "v") == [1234.5, 45, -120, 7, None, None, 1000]
    b = frame(spark, "t string", [(x,) for x in ("yes", "No", "Y", "f", "1", "0", "perhaps")])
    assert column(b.select(C.to_boolean(F.col("t")).alias("v")), "v") == [True, False, True, False, True, False, None]


def test_dates_are_gated(spark):
    d = frame(spark, "d string", [("2024-01-05",), ("Jan 5, 2024",), ("01/05/2024",), ("bad",)])
    assert column(prepare.standardize_dates(d, "d"), "d") == [datetime.date(2024, 1, 5)] * 3 + [None]
    bad = frame(spark, "d string", [("2024-01-05",), ("x",), ("y",)])
    assert prepare.standardize_dates(bad, "d").dtypes == [("d", "string")]


def test_categories_and_gender(spark):
    d = frame(spark, "v string", [("USA",)] * 3 + [("usa",), ("Usa",), ("UK",), ("UK",), (None,)])
    got = sorted(map(str, column(prepare.normalize_categories(d, "v"), "v")))
    assert got == ["None"] + ["UK"] * 2 + ["USA"] * 5
    g = frame(spark, "gender string", [(x,) for x in ("M", "male", "F", "Woman", "x", None)])
    assert column(prepare.standardize_gender(g), "gender") == ["Male", "Male", "Female", "Female", "x", None]


@pytest.mark.parametrize("good,kind", [(94, "string"), (95, "bigint")])
def test_conversion_gate(spark, good, kind):
    d = frame(spark, "v string", [(str(k),) if k < good else ("x",) for k in range(100)])
    assert dict(prepare.convert_types(d, {"v": "numeric"}).dtypes)["v"] == kind


def test_signs_and_ages(spark):
    rows = [(-2, "shipped", -5.0), (-2, "cancelled", -5.0), (-2, "returned", 5.0), (-2, "pending", 5.0), (-2, "pending", -5.0)]
    out = prepare.repair_signs(frame(spark, "q int, s string, a double", rows), "q", "s", "a")
    assert column(out, "q") == [2, 2, -2, 2, -2] and column(out, "a") == [5, -5, 5, 5, -5]
    ages = frame(spark, "age double", [(x,) for x in (-1.0, 200.0, 30.0, 40.0, 50.0)])
    assert column(prepare.repair_ages(ages), "age") == [40, 40, 30, 40, 50]
    usage = frame(spark, "usage double", [(-1.0,)])
    assert column(prepare.repair_ages(usage), "usage") == [-1]


def test_imputation(spark):
    rows = [(k, float(k) if k % 10 else None, k % 3 if k % 8 else None, float(k) if k % 2 else None, "a" if k % 5 < 3 else "b" if k % 5 == 3 else None) for k in range(100)]
    d = frame(spark, "row_id int, many double, few int, sparse double, cat string", rows)
    out = prepare.handle_missing(d, profile(d).columns)
    n = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in d.columns]).first()
    assert n["many"] == 0 and n["few"] == 0 and n["sparse"] == 50 and n["cat"] == 0


def test_duplicates(spark):
    d = frame(spark, "a int, b string", [(1, "x"), (2, "y"), (1, "x"), (None, "x"), (None, "x")])
    assert prepare.drop_duplicate_rows(d).count() == 3
    nested = frame(spark, "a int, l array<int>", [(1, [1]), (1, [1]), (1, [2])])
    assert prepare.drop_duplicate_rows(nested).count() == 2
    assert prepare.drop_duplicate_rows(prepare.drop_duplicate_rows(d)).count() == 3
    first = frame(spark, "n int, b string", [(3, "x"), (1, "x"), (2, "y")])
    assert sorted(map(tuple, prepare.drop_duplicate_rows(first, order="n").collect())) == [(1, "x"), (2, "y")]


def test_profile_types(spark):
    rows = [(k, f"{k}", ["yes", "No"][k % 2], f"2024-01-{k % 28 + 1:02d}", ["Red ", "red", "Blue"][k % 3], f"12 Main St {k}") for k in range(60)]
    p = profile(frame(spark, "id int, amount string, ok string, day string, colour string, street string", rows))
    assert {n: c.logical_type for n, c in p.columns.items()} == {"id": "numeric", "amount": "numeric", "ok": "boolean", "day": "datetime", "colour": "categorical", "street": "text"}
    assert p.columns["id"].id_candidate and p.columns["colour"].issues["inconsistent_casing"] == 1 and p.duplicate_rows == 0
    empty = profile(frame(spark, "a int, b string", []))
    assert empty.rows == 0 and empty.columns["a"].constant


def test_matching_and_joins(spark):
    parents = frame(spark, "customer_id long, name string, status string", [(k, f"n{k}", "p") for k in range(1, 101)])
    child = frame(spark, "order_id long, cust_id string, status string", [(1000 + k, f"{k % 110 + 1}.0", "c") for k in range(200)])
    ps = {"customers": profile(parents), "orders": profile(child)}
    matches = integrate.match_schemas({"customers": parents, "orders": child}, ps)
    assert (matches[0].left_column, matches[0].right_column) == ("customer_id", "cust_id")
    rel = integrate.detect_relationships(matches, ps)
    assert rel[0]["type"] == "one_to_many" and rel[0]["parent"] == ("customers", "customer_id")
    out, notes = integrate.build_integrated({"customers": parents, "orders": child}, rel, ps)
    joined = out["orders_with_customers"]
    assert joined.columns == ["order_id", "cust_id", "status", "name", "customers_status"] and joined.count() == 200
    doubled = parents.unionByName(parents)
    assert integrate.lookup_join(child, doubled, "cust_id", "customer_id", "customers").count() == 200
    r = integrate.key_resolution(child, parents, "cust_id", "customer_id").first()
    assert r["unmatched"] == notes[0]["unmatched"] and r["status"] == "warning"
    low, why = integrate.build_integrated({"customers": parents.filter("customer_id < 40"), "orders": child}, rel, ps)
    assert not low and "resolve" in why[0]["reason"]
    assert integrate.score_match(0.2, 1.0, 1.0, True, False) < 0.55


def test_validation(spark):
    d = frame(spark, "id int, v double", [(1, 1.0), (1, 2.0), (2, None)])
    status = {c["check"]: c["status"] for c in integrate.validate(d, profile(d))}
    assert status["identifier id"] == "warning" and status["missing v"] == "warning"
    missing = frame(spark, "id int", [(1,), (None,)])
    assert {c["check"]: c["status"] for c in integrate.validate(missing, profile(missing))}["identifier id"] == "failed"
    none = frame(spark, "id int", [])
    assert integrate.validate(none, profile(none))[0]["status"] == "failed"


def test_trends(spark):
    d = frame(spark, "d string, v double, g string", [("2023-01-15", 10.0, "a"), ("2023-03-04", 30.0, "a"), ("2023-03-15", 5.0, "b"), (None, 1.0, "a"), ("2023-07-22", None, "a"), ("2023-05-02", 7.0, None)])
    d = d.withColumn("d", F.col("d").cast("date"))
    t = [(str(r.period), r.value) for r in trends.trend(d, "d", "v").orderBy("period").collect()]
    assert t == [("2023-01-31", 10), ("2023-02-28", 0), ("2023-03-31", 35), ("2023-04-30", 0), ("2023-05-31", 7)]
    s = trends.trend_summary(d, "d", "v").first()
    assert (s.direction, s.total_change_percent, str(s.drop_period), s.drop_percent, str(s.rise_period), s.rise_percent) == ("decreasing", -30.0, "2023-02-28", -100.0, "2023-03-31", None)
    c = trends.compare_periods(d, "d", "v").first()
    assert (c.period_a, c.period_b, c.value_a, c.value_b, c.direction) == ("2023-03", "2023-05", 35, 7, "decrease")
    g = {r.category: r.percent_change for r in trends.compare_periods(d, "d", "v", group="g").collect()}
    assert g == {"a": -100.0, "b": -100.0}
    assert trends.frequency("whenever") == "month"
    assert trends.trend(d.filter("false"), "d", "v").count() == 0


def test_trend_with_long_gaps(spark):
    rows = [("2023-01-15", 1481000.0, "x"), ("2023-03-04", 3000000.0, "x"), ("2023-03-15", 274000.0, "y"), ("2023-07-22", 1868000.0, "x")]
    d = frame(spark, "d string, v double, g string", rows).withColumn("d", F.col("d").cast("date"))
    s = trends.trend_summary(d, "d", "v").first()
    assert (s.total_change_percent, str(s.drop_period), s.drop_percent, str(s.rise_period)) == (26.13, "2023-02-28", -100.0, "2023-03-31")
    c = trends.compare_periods(d, "d", "v").first()
    assert (c.period_a, c.period_b, c.absolute_change, c.percent_change) == ("2023-03", "2023-07", -1406000.0, -42.94)


def test_anomalies(spark):
    d = frame(spark, "v double", [(float(x),) for x in [1, 2, 3, 2, 1, 2, 3, 500]])
    assert column(anomaly.univariate(d, "v"), "v") == [500]
    assert anomaly.univariate(frame(spark, "v double", [(1.0,), (2.0,), (900.0,)]), "v").count() == 0
    rows = [(k, (k * 37 % 101) / 10, (k * 53 % 97) / 10) for k in range(200)] + [(999, 500.0, -400.0)]
    found = anomaly.multivariate(frame(spark, "k int, x double, y double", rows), "k", ["x", "y"], trees=60)
    assert found.orderBy(F.desc("score")).first()["k"] == 999
    with pytest.raises(ValueError):
        anomaly.multivariate(d.withColumn("k", F.lit(1)), "k", ["v"])


def test_ranking_and_charts(spark):
    d = frame(spark, "g string, v double", [("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", 9.0), (None, 50.0)])
    r = analysis.rank_categories(d, "g", "v", "sum", 0).collect()
    assert [(x.rank_type, x.category) for x in r] == [("top", "c"), ("bottom", "b")]
    with pytest.raises(ValueError):
        analysis.rank_categories(d, "g", "g")
    with pytest.raises(ValueError):
        analysis.rank_categories(d, "g", "v", "product")
    h = charts.histogram(d, "v", 4).orderBy("bin").collect()
    assert sum(x["count"] for x in h) == 5 and len(h) == 4
    assert charts.histogram(frame(spark, "v double", [(2.0,), (2.0,)]), "v", 3).agg(F.sum("count")).first()[0] == 2


def test_search(spark):
    v = frame(spark, "k int, e array<float>", [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])])
    assert column(search.nearest(v, "k", "e", [1.0, 0.1], 2), "k") == [1, 3]
    t = frame(spark, "k int, t string", [(1, "red apples and pears"), (2, "blue sky"), (3, None)])
    assert search.text_search(t, "k", "t", "apples pears", 1).first()["k"] == 1


def test_models(spark):
    rows = [(k, float(k % 20), "ab"[k % 2], "yes" if (k % 20) > 9 else "no", float(k % 20) * 3 + 1) for k in range(200)]
    d = frame(spark, "row_id int, x double, c string, churn string, y double", rows)
    m = ml.train_model(d, "churn", trees=10)
    assert m["task_type"] == "classification" and m["metrics"]["accuracy"] > 0.9 and m["train_rows"] + m["test_rows"] == 200
    assert ml.train_model(d, "y", trees=10, features=["x"])["metrics"]["r2"] > 0.9
    assert ml.analyze_churn(d, trees=10)["churn_rate_percent"] == 50.0
    assert "error" in ml.train_model(d.limit(5), "churn")
    rel = ml.assess_feature_relevance(d, profile(d), target="churn")
    assert rel["ranking"][0]["column"] in ("x", "y") and "row_id" in rel["low_relevance"]


def test_sql_guard(spark):
    t = {"t": spark.range(300).withColumnRenamed("id", "load")}
    ok = lambda q: sql.run_sql_query(t, q)
    assert ok("SELECT 1;")["row_count"] == 1
    assert "error" in ok("SELECT 1; SELECT 2") and "error" in ok("DROP TABLE t") and "error" in ok(" ")
    assert ok("WITH x AS (SELECT 1 AS a) SELECT * FROM x")["rows"] == [{"a": 1}]
    big = ok('SELECT "load" FROM t')
    assert big["truncated"] and big["returned_rows"] == 200 and big["row_count"] == 300
    assert ok("SELECT replace('a;b', ';', '-') AS r FROM t LIMIT 1")["rows"] == [{"r": "a-b"}]
    assert "error" in ok("SELECT reflect('java.lang.System', 'getProperty', 'user.home')")
    assert "error" in ok("SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`")
    assert "error" in ok("INSERT INTO t SELECT 1") and "error" in ok("SET a=b") and "error" in ok("FROM t INSERT INTO t SELECT 1")


def test_sources(spark, tmp_path):
    put = lambda n, b: (tmp_path / n).write_bytes(b) and str(tmp_path / n)
    for sep in (";", "\t", "|", ","):
        t = files.load_file(spark, put("a.csv", f"x{sep}y\n1{sep}NA\n\n2{sep}b\n".encode()))[0]
        assert t.frame.columns == ["x", "y"] and sorted(map(tuple, t.frame.collect())) == [("1", None), ("2", "b")]
    assert files.load_file(spark, put("b.csv", "\ufeffn\né\n".encode()))[0].frame.first()["n"] == "é"
    assert files.load_file(spark, put("c.csv", "n\né€\n".encode("cp1252")))[0].frame.first()["n"] == "é€"
    (tmp_path / "empty.csv").write_bytes(b"")
    for bad in (str(tmp_path / "empty.csv"), put("x.unknown", b"a"), put("h.csv", b"a,b\n")):
        with pytest.raises(files.LoadError):
            files.load_file(spark, bad)
    with pytest.raises(files.LoadError):
        files.load_file(spark, str(tmp_path / "none.csv"))
    assert files.load_file(spark, put("l.json", b'[{"a": 1}, {"a": 2}]'))[0].frame.count() == 2
    assert files.load_file(spark, put("o.json", b'{"data": [{"a": 1}, {"a": 2}], "x": [{"b": 1}]}'))[0].frame.columns == ["a"]
    assert files.load_file(spark, put("n.json", b'{"customer": {"customer_id": 34}, "tags": ["a"]}'))[0].frame.columns == ["customer_customer_id", "tags"]
    assert files.load_file(spark, put("j.jsonl", b'{"a": 1}\n{"a": 2}\n'))[0].frame.count() == 2
    with pytest.raises(files.LoadError):
        files.load_file(spark, put("s.json", b"5"))
    assert files.validate_csv(spark, put("v.csv", b"a,b\n1,2\n"))["rows"] == 1 and not files.validate_csv(spark, "nothing.csv")["valid"]


def workbook(path, sheets):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            cells = "".join("<row>" + "".join(f'<c r="{chr(65 + i)}{j + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(r)) + "</row>" for j, r in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{ns}"><sheetData>{cells}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "Book 1.xlsx")
    workbook(path, {"orders": [["a", "b"], ["1", "x"], ["2", "y"]], "empty": [], "products": [["p"], ["q"]]})
    tables = files.load_file(spark, path)
    assert [t.name for t in tables] == ["book_1_orders", "book_1_products"] and tables[0].frame.count() == 2


def test_preparation_of_files(spark, tmp_path):
    customers = "Customer ID,Full Name,Gender,Age\n" + "".join(f"{k},Name {k},{'M' if k % 2 else 'female'},{20 + k % 50}\n" for k in range(1, 121)) + "120,Name 120,female,40\n"
    orders = "order_id;cust_id;order_date;amount\n" + "".join(f"{5000 + k};{k % 120 + 1};2024-0{k % 6 + 1}-15;${k}.50\n" for k in range(240))
    (tmp_path / "customers.csv").write_text(customers)
    (tmp_path / "orders.csv").write_text(orders)
    (tmp_path / "bad.xyz").write_text("x")
    out = report.prepare_uploads(spark, "s1", [str(tmp_path / n) for n in ("customers.csv", "orders.csv", "bad.xyz")], str(tmp_path / "out"))
    assert out["ready"] and len(out["errors"]) == 1 and {"customers", "orders", "orders_with_customers"} <= set(out["datasets"])
    assert out["datasets"]["orders_with_customers"].count() == 240
    assert dict(out["datasets"]["orders"].dtypes)["amount"] == "double" and dict(out["datasets"]["orders"].dtypes)["order_date"] == "date"
    assert set(out["datasets"]["customers"].select("gender").distinct().toPandas()["gender"]) == {"Male", "Female"}
    path = str(tmp_path / "r" / "report.json")
    report.save_report(out["report"], path)
    again = report.merge_reports(report.load_report(path), out["report"])
    assert again["summary"] == out["report"]["summary"] and len(again["errors"]) == 1 and report.caveats(again)
    json.dumps(again)

    root = str(tmp_path / "sessions")
    assert report.get_report(spark, root, "s1") is None and report.agent_context(spark, root, "s1") == "" and not report.delete_session_artifacts(spark, root, "s1")
    report.keep_report(spark, root, out["report"])
    report.keep_report(spark, root, out["report"] | {"session_id": "s2"})
    assert report.keep_report(spark, root, out["report"])["summary"] == out["report"]["summary"] == report.get_report(spark, root, "s1")["summary"]
    lines = report.agent_context(spark, root, "s1").splitlines()
    assert any(x.startswith("- orders: ") for x in lines) and any(x.startswith("- orders_with_customers: joined, 240") for x in lines) and "Caveats:" in lines
    assert report.delete_session_artifacts(spark, root, "s1") and report.get_report(spark, root, "s1") is None and report.get_report(spark, root, "s2")
    for bad in ("", ".", "..", "a/b", "../s2"):
        with pytest.raises(ValueError):
            report.delete_session_artifacts(spark, root, bad)


def test_tools(spark, tmp_path):
    rows = [(k, ["a", "b", "c"][k % 3], float(k % 17), datetime.date(2024, 1 + k % 6, 1 + k % 28), "yes" if k % 4 == 0 else "no") for k in range(120)]
    tables = {"sales": frame(spark, "id int, category string, amount double, day date, churn string", rows)}
    calls = {
        "get_dataset_info": {}, "get_dataset_statistics": {}, "get_dataset_profile": {}, "analyze_column": {"column_name": "category"}, "compare_categories": {"category_column": "category", "target_column": "amount"},
        "rank_categories": {"category_column": "category", "metric_column": "amount"}, "create_churn_plot": {}, "create_visualization": {"chart_type": "histogram", "column": "amount"}, "analyze_churn": {},
        "train_model": {"target_column": "churn"}, "assess_feature_relevance": {"target_column": "churn"}, "detect_anomalies": {"column": "amount"}, "analyze_trends": {"date_column": "day", "value_column": "amount"},
        "compare_periods": {"date_column": "day", "value_column": "amount", "group_column": "category"}, "run_sql_query": {"sql_query": "SELECT count(*) AS n FROM sales"}, "semantic_search": {"text_column": "category", "query": "a"},
        "generate_report": {"folder": str(tmp_path)}, "generate_business_report": {"folder": str(tmp_path)}, "deliver_business_report": {"folder": str(tmp_path)},
    }
    assert set(calls) == set(registry.TOOLS) and len(calls) == 19
    for name, arguments in calls.items():
        out = registry.dispatch(name, tables, arguments)
        assert "error" not in out, (name, out)
        json.dumps(report.plain(out))
    for name, arguments in (("analyze_column", {"column_name": "none"}), ("nothing", {}), ("rank_categories", {"category_column": "category"}), ("detect_anomalies", {"column": "category"}), ("analyze_column", {"dataset_name": "x"})):
        assert "error" in registry.dispatch(name, tables, arguments)


def test_store(tmp_path):
    s = SessionStore(str(tmp_path / "s.db"))
    k = s.create("t")
    s.add_dataset(k, "a", "1"), s.add_dataset(k, "b", "2"), s.add_dataset(k, "a", "3")
    s.append(k, "user", "hi")
    assert s.datasets(k) == {"a": "3", "b": "2"} and s.recent(k) == [{"role": "user", "content": "hi"}]
    assert s.list()[0]["messages"] == 1 and s.delete(k) and s.get(k) is None


def test_scatter_gives_all_points(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    many = part.crossJoin(spark.range(2000 // part.count() + 1))
    out = charts.scatter(many, "p_size", "p_retailprice")
    assert out.count() == many.dropna(subset=["p_size", "p_retailprice"]).count() > 500
    from millrace.plans import catalogue

    whole = catalogue.QUERIES["scatter_points"](spark, "/root/testdata/sf0.1")
    assert whole.count() == spark.read.parquet("/root/testdata/sf0.1/part.parquet").dropna(subset=["p_size", "p_retailprice"]).count() > 500


def test_sql_guard_sees_every_part_of_a_plan(spark):
    t = {"sales": spark.createDataFrame([("a", 1)], "category string, n int")}
    call = "reflect('java.lang.System', 'getProperty', 'user.home')"
    refused = [
        "SELECT " + ", ".join(f"{k} AS c{k}" for k in range(40)) + f", {call}",
        f"SELECT (SELECT max({call}) FROM sales) AS x",
        f"SELECT category FROM sales GROUP BY category HAVING max({call}) > ''",
        f"WITH t AS (SELECT {call} AS x) SELECT * FROM t",
        f"SELECT * FROM sales WHERE EXISTS (WITH t AS (SELECT {call} AS x) SELECT * FROM t)",
        f"SELECT * FROM sales ORDER BY {call}",
        f"SELECT sum(n) OVER (PARTITION BY {call}) FROM sales",
        f"SELECT transform(array(1), x -> {call}) AS x",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM IDENTIFIER('sal' || 'es')",
        "SELECT * FROM parquet.`/etc`",
        "SELECT * FROM sales JOIN (SELECT * FROM csv.`/etc/passwd`)",
        "SELECT Java_Method('java.lang.System', 'getProperty', 'user.home')",
        "DROP TABLE sales",
    ]
    for q in refused:
        assert "error" in sql.run_sql_query(t, q), q
    assert sql.run_sql_query(t, "SELECT 'reflect(' AS reflect FROM sales")["rows"]
    assert not [v for v in spark.catalog.listTables("global_temp") if v.name.startswith("millrace_")]
    assert sql.run_sql_query(t, "WITH t AS (SELECT n FROM sales) SELECT sum(n) AS s, count(*) AS k FROM t")["rows"] == [{"s": 1, "k": 1}]


def test_late_accents_decide_the_encoding(spark, tmp_path):
    from millrace.sources import files

    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"x,y\n" * 30_000 + "caf\u00e9,\u20ac5\n".encode("cp1252"))
    df, notes = files.read_delimited(spark, str(path))
    assert df.filter("a not in ('x')").collect()[0].asDict() == {"a": "caf\u00e9", "b": "\u20ac5"} and "cp1252" in notes[0]
    path.write_bytes(b"a,b\n" + b"x,y\n" * 30_000 + b"\x81,\xe9\n")
    assert "latin-1" in files.read_delimited(spark, str(path))[1][0]
    path.write_bytes(b"a,b\n" + b"x,y\n" * 30_000 + "caf\u00e9,\u20ac5\n".encode())
    assert "utf-8" in files.read_delimited(spark, str(path))[1][0]


def test_nulls_do_not_count_in_anomaly_rates(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 2, 3, 4, 3, 900]] + [(None,)] * 10, "x double")
    r = anomaly.summary(df, "x").first()
    assert (r.total_rows, r.anomaly_count, r.anomaly_rate_percent) == (10, 1, 10.0)


def test_numbers_shown_as_dates_are_dates(tmp_path):
    import zipfile

    from millrace.sources.files import serial_date, sheets_of

    assert [serial_date(x) for x in (1, 59, 61, 45292, 45292.5, 0.25, -1, 3e6)] == ["1900-01-01", "1900-02-28", "1900-03-01", "2024-01-01", "2024-01-01 12:00:00", "06:00:00", None, None]
    assert serial_date(0, True) == "1904-01-01"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    styles = f"""<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/><numFmt numFmtId="166" formatCode="[Red]#,##0"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="22"/></cellXfs></styleSheet>"""
    cells = "".join(f'<c r="{chr(65 + k)}2" s="{k}"><v>45292.5</v></c>' for k in range(6))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="2">{cells}</row></sheetData></worksheet>')
    ((name, rows),) = sheets_of((tmp_path / "b.xlsx").read_bytes())
    date = "2024-01-01 12:00:00"
    assert name == "S" and rows == [["45292.5", date, date, "45292.5", "45292.5", date]]


def test_frequent_spellings_win_in_long_maps_too(spark, monkeypatch):
    from millrace.operators import prepare

    rows = [("Rome",)] * 5 + [("ROME",), (" rome ",), (None,), ("Paris",), ("paris",), ("paris",)]
    df = spark.createDataFrame(rows, "city string")
    for most in (10_000, 0):
        monkeypatch.setattr(prepare, "SPELLINGS", most)
        got = sorted((r.city or "") for r in prepare.normalize_categories(df, "city").collect())
        assert got == sorted(["Rome"] * 7 + [""] + ["paris"] * 3)


def test_functions_that_analysts_expect(spark):
    from millrace.operators import sql as sqltool

    t = spark.createDataFrame([("2024-03-05 07:08:09.5", "a.b.c", "x'y")], "at string, s string, q string").selectExpr("cast(at as timestamp_ntz) as at", "s", "q")
    one = lambda text: tuple(sqltool.query({"t": t}, f"SELECT {text} FROM t").first())
    assert one("strftime(at, '%d/%m/%y %I:%M %p''s 100%% T%H')") == ("05/03/24 07:08 AM's 100% T07",)
    assert one("strftime(at, '%A %j'), strftime(at, ''), strftime(at, '%Y%m%d')") == ("Tuesday 065", "", "20240305")
    assert one("strptime('05.03.2024', '%d.%m.%Y') = DATE '2024-03-05', try_strptime('x', '%Y') IS NULL, isodow(at), epoch(at) - floor(epoch(at))") == (True, True, 2, 0.5)
    assert one("string_split(s, '.'), regexp_matches(s, 'b'), regexp_full_match(s, 'b'), regexp_full_match(s, 'a.+|z'), strpos(s, 'c'), prefix(s, 'a'), suffix(s, 'a')") == (["a", "b", "c"], True, False, True, 5, True, False)
    assert [r[0] for r in sqltool.query({"t": t}, "SELECT * FROM generate_series(2, 4)").collect()] == [2, 3, 4]
    assert sqltool.query({"t": t}, "SELECT * FROM generate_series(4, 2)").count() == 0
    assert "error" in sqltool.run_sql_query({"t": t}, "SELECT reflect('java.lang.System', 'exit', 0) FROM t")


def test_sketches_bound_overlaps_and_keep_all_matches(spark, monkeypatch):
    from millrace.operators import integrate
    from millrace.operators.profile import profile

    r = spark.range(20_000)
    big = r.selectExpr("id * 7 AS customer_key", "id % 90 AS grade", "concat('n', id) AS label")
    small = spark.range(3000).selectExpr("id * 14 AS cust_key", "id AS position", "concat('m', id) AS label", "id % 90 + 1000 AS other_grade")
    tables = {"big": big, "small": small}
    pairs = [("big", x, "small", y) for x in big.columns for y in small.columns]
    bounds = integrate.possible_overlaps(tables, pairs)
    exact = {(o.table_a, o.column_a, o.table_b, o.column_b): o.shared / min(o.size_a, o.size_b) for o in integrate.key_overlaps({"big": (big, big.columns), "small": (small, small.columns)}).collect()}
    assert all(bounds[p] >= exact.get(p, 0.0) for p in pairs)
    assert bounds["big", "customer_key", "small", "cust_key"] == 1.0 and bounds["big", "grade", "small", "other_grade"] == 0.0 and bounds["big", "label", "small", "label"] < 0.2

    profiles = {t: profile(df) for t, df in tables.items()}
    seen = []
    real = integrate.key_overlaps
    monkeypatch.setattr(integrate, "key_overlaps", lambda t: seen.append(sum(len(cs) for _, cs in t.values())) or real(t))
    found = integrate.match_schemas(tables, profiles)
    monkeypatch.setattr(integrate, "possible_overlaps", lambda t, p: dict.fromkeys(p, 1.0))
    assert integrate.match_schemas(tables, profiles) == found and found[0].left_column == "customer_key"
    assert seen[0] < seen[1]


def test_limits_by_outer_value_follow_an_order_over_columns_that_are_not_selected(spark):
    t = {"c": spark.range(3).withColumnRenamed("id", "k"), "o": spark.sql("SELECT id AS o, id % 3 AS k, -id AS p FROM range(20)").repartition(7)}
    for text, want in (
        ("SELECT k, o FROM c, LATERAL (SELECT o FROM o WHERE o.k = c.k ORDER BY p DESC, o LIMIT 2) t", [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]),
        ("SELECT k, o FROM c, LATERAL (SELECT o FROM o WHERE o.k = c.k ORDER BY p DESC LIMIT 1 OFFSET 1) t", [(0, 3), (1, 4), (2, 5)]),
        ("SELECT k, (SELECT o FROM o WHERE o.k = c.k ORDER BY p LIMIT 1) AS x FROM c", [(0, 18), (1, 19), (2, 17)]),
    ):
        out = sql.query(t, text)
        assert sorted(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all(" p#" in x.partition("specifiedwindowframe")[0] for x in plan.split("windowspecdefinition(")[1:]), plan  # not by chance
    assert [r.o for r in sql.query(t, "SELECT o FROM o ORDER BY p LIMIT 3").collect()] == [19, 18, 17]


def test_training_deals_rows_to_tasks_of_bounded_size(spark, monkeypatch):
    df = spark.range(900).selectExpr("id % 30 AS size", "concat('b', id % 4) AS brand", "id % 30 * 2 + id % 4 * 10 AS price", "if(id % 4 = 1, 'yes', 'no') AS churn").coalesce(1)
    parts = []
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    for model in (ml.RandomForestRegressor, ml.RandomForestClassifier):
        monkeypatch.setattr(model, "fit", lambda self, rows, fit=model.fit: (parts.append([len(x) for x in rows.rdd.glom().collect()]), fit(self, rows))[1])
    out = ml.train_model(df.drop("churn"), "price", trees=5)
    assert out["train_rows"] + out["test_rows"] == 900 and out["metrics"]["r2"] > 0.5
    assert ml.train_model(df.drop("price"), "churn", trees=5)["metrics"]["accuracy"] > 0.9
    assert ml.analyze_churn(df, trees=5)["rows_used"] == 900
    assert len(parts) == 3 and all(len(p) == 9 and max(p) <= 110 for p in parts) and sum(parts[2]) == 900
