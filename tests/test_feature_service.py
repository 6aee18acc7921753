"""A feature service on this machine, which records what it is asked and answers by SQL."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import duckdb
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, Not, StringContains, StringStartsWith

from furrow.sources import arcgis

FIELDS = "Farm_Code string, Farm_Name string, Area double, OBJECTID long"
CODES = ["F001", "F002", "O'Hara_1", "50%_x", "50aax", None, "f001", ""]


@pytest.fixture(scope="module")
def service():
    con = duckdb.connect()
    con.execute("CREATE TABLE features (Farm_Code VARCHAR, Farm_Name VARCHAR, Area DOUBLE, OBJECTID BIGINT, x DOUBLE, y DOUBLE)")
    rows = [(CODES[k % 8], f"Farm {k}", None if k % 11 == 0 else k * 1.5, 10 + k * (1 if k < 200 else 7), -170.0 + k, (k % 160) - 80.0) for k in range(300)]
    con.executemany("INSERT INTO features VALUES (?, ?, ?, ?, ?, ?)", rows)
    asked, lock = [], threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            where = q["where"]
            if "geometry" in q:
                west, south, east, north = map(float, q["geometry"].split(","))
                where = f"({where}) AND x BETWEEN {west} AND {east} AND y BETWEEN {south} AND {north}"
            with lock:
                asked.append(q)
                if "outStatistics" in q:
                    stats = ", ".join(f"{s['statisticType']}({s['onStatisticField']})" for s in json.loads(q["outStatistics"]))
                    least, most, n = con.execute(f"SELECT {stats} FROM features WHERE {where}").fetchone()
                    answer = {"features": [{"attributes": {"MIN": least, "MAX": most, "COUNT": n}}]}
                else:
                    names = "Farm_Code,Farm_Name,Area,OBJECTID" if q["outFields"] == "*" else q["outFields"]
                    limit = min(int(q["resultRecordCount"]), 40)  # the service gives 40 at a time
                    found = con.execute(f"SELECT x, y, {names} FROM features WHERE {where} ORDER BY {q['orderByFields']} LIMIT {limit + 1}").fetchall()
                    features = [{"attributes": dict(zip(names.split(","), r[2:], strict=True)), "geometry": {"x": r[0], "y": r[1]}} for r in found[:limit]]
                    answer = {"features": features, "exceededTransferLimit": len(found) > limit}
            raw = json.dumps(answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(raw)

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/0", asked, rows
    server.shutdown()


def test_all_rows_by_key(spark, service):
    url, asked, rows = service
    asked.clear()
    found = arcgis.read_service(spark, url, FIELDS, page="50")
    assert sorted(map(tuple, found.collect()), key=lambda r: r[3]) == rows
    pages = [q for q in asked if "outFields" in q]
    assert {q["orderByFields"] for q in pages} == {"OBJECTID"} and {q["outFields"] for q in pages} == {"OBJECTID,Farm_Code,Farm_Name,Area"}
    assert not any("resultOffset" in q for q in pages) and found.rdd.getNumPartitions() == 6
    spark.dataSource.register(arcgis.ArcGisSource)
    text = spark.read.format("arcgis").options(url=url).load()
    assert text.columns == ["attributes", "x", "y"] and text.count() == 300


@pytest.mark.parametrize(
    ("test", "said"),
    [
        ("Farm_Code = 'O\\'Hara_1'", "(Farm_Code = 'O''Hara_1')"),
        ("contains(Farm_Code, '0%_')", "(Farm_Code LIKE '%0__%')"),
        ("startswith(Farm_Code, '50%')", "(Farm_Code LIKE '50_%')"),
        ("Area > 100.5D", "(Area > 100.5)"),
        ("Farm_Code IS NULL", "(Farm_Code IS NULL)"),
        ("Farm_Code IN ('F001', 'x\\'y')", "(Farm_Code IN ('F001', 'x''y'))"),
        ("x > -20D AND y <= 10D", None),
        ("Area <= 30D AND OBJECTID >= 15", "(Area <= 30.0)"),
        ("Farm_Code > 'F001'", None),
        ("Area < 10D OR Farm_Code = 'F002'", None),
    ],
)
def test_filters_reach_the_service(spark, service, test, said):
    url, asked, rows = service
    whole = spark.createDataFrame(rows, FIELDS + ", x double, y double")
    asked.clear()
    found = arcgis.read_service(spark, url, FIELDS).filter(test)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.filter(test).collect()))
    assert all((said or "") in q["where"] for q in asked)
    if test.startswith("x"):
        assert {q["geometry"] for q in asked} == {"-20.0,-90.0,180.0,10.0"}


def test_search_terms_as_the_search_box_sends_them(spark, service):
    url, asked, rows = service
    asked.clear()
    found = arcgis.suggestions(spark, url, "Farm_Code", "O'H%ar_a", "Farm_Code string, Farm_Name string")
    assert {r.Farm_Code for r in found.collect()} == {"O'Hara_1"}
    assert all("(Farm_Code LIKE '%O''Hara%')" in q["where"] for q in asked)
    assert arcgis.suggestions(spark, url, "Farm_Code", "nothing like it", FIELDS).count() == 0
    assert [arcgis.escaped_term(t) for t in (None, "a_b%", "d'e")] == ["", "ab", "d''e"]


def test_clauses():
    fields = {"a", "b"}
    assert arcgis.clause(EqualTo(("c",), 1), fields) is None and arcgis.clause(EqualTo(("a", "b"), 1), fields) is None
    assert arcgis.clause(Not(EqualTo(("a",), 1)), fields) is None and arcgis.clause(GreaterThan(("a",), "x"), fields) is None
    assert arcgis.clause(EqualTo(("a",), True), fields) is None and arcgis.clause(In(("a",), (1, None)), fields) == "a IN (1)"
    assert arcgis.clause(LessThanOrEqual(("a",), 3), fields) == "a <= 3" and arcgis.clause(IsNull(("b",)), fields) == "b IS NULL"
    assert arcgis.clause(StringStartsWith(("a",), "%'"), fields) == "a LIKE '_''%'" and arcgis.clause(StringContains(("a",), "z"), fields) == "a LIKE '%z%'"


def test_too_many_pages_and_errors_raise(spark, service, tmp_path):
    url, _, _ = service
    with pytest.raises(Exception, match="more than the 2 allowed"):
        arcgis.read_service(spark, url, FIELDS, page="50", pages="2").count()
    (tmp_path / "part-0.txt").write_text('{"features": [{"attributes": {"n": "7", "s": {"a": 1}}}, {"attributes": {"n": "x"}}]}\n{}\n')
    (tmp_path / "_SUCCESS").write_text("")
    found = spark.read.format("arcgis").options(path=str(tmp_path), fields="n long, s string, b boolean").load()
    assert sorted(map(str, map(tuple, found.collect()))) == ["(7, '{\"a\": 1}', None, None, None)", "(None, None, None, None, None)"]
