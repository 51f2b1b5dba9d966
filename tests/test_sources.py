"""Paged answers, sets of tables, archives and append loops: restarts and crashes."""

from __future__ import annotations

import csv
import http.server
import io
import json
import random
import threading
import zipfile
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import files, manifest
from ledgerline.sources.paged import PagedJson
from ledgerline.streaming import changes


class Service(http.server.BaseHTTPRequestHandler):
    """Pages 1 to `last`; some requests are refused a few times."""

    last, refused, asked = 5, {}, []

    def do_GET(self):  # noqa: N802
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        name = q.get("page") or q.get("ids")
        type(self).asked.append(name)
        left = self.refused.get(name, (0, 0, ""))
        if left[0]:
            type(self).refused[name] = (left[0] - 1, *left[1:])
            return self.answer(left[1], left[2])
        if "page" in q and int(q["page"]) > self.last:
            return self.answer(404, "")
        return self.answer(200, "" if name == "EMPTY" else json.dumps({"of": name}))

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def service(spark):
    spark.dataSource.register(PagedJson)
    Service.last, Service.refused, Service.asked = 5, {}, []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x"
    server.shutdown()


def test_pages_and_batches(spark, service):
    Service.refused = {"2": (2, 403, '{"error": {"errors": [{"reason": "quotaExceeded"}]}}'), "4": (99, 500, "broken"), "5": (99, 429, "")}
    read = spark.read.format("paged_json").option("delay", 0.01).option("attempts", 3).option("tasks", 2)
    got = {r.page: r for r in read.option("url", service + "?page={page}").option("pages", 5).load().collect()}
    assert [got[p].body for p in range(1, 6)] == ['{"of": "1"}', '{"of": "2"}', '{"of": "3"}', None, None]
    assert got[4].error.startswith("HTTPError") and got[5].error.startswith("QuotaExhausted") and got[1].error is None
    assert Service.asked.count("2") == 3 and Service.asked.count("4") == 1
    keys = [f"k{i}" for i in range(120)]
    rows = read.option("url", service + "?ids={keys}").option("keys", ";".join([*keys, "k1", " "])).load().collect()
    assert sorted(len(r.keys.split(";")) for r in rows) == [20, 50, 50] and {k for r in rows for k in r.keys.split(";")} == set(keys)
    assert all(json.loads(r.body)["of"] == r.keys for r in rows)
    assert read.option("url", service + "?ids={keys}").option("keys", "EMPTY").load().collect()[0][2:] == (None, None)


def test_rate_is_shared(spark, service):
    import time

    began = time.monotonic()
    n = spark.read.format("paged_json").option("url", service + "?page={page}").option("pages", 5).option("tasks", 1).option("rate", 10).load().count()
    assert n == 5 and time.monotonic() - began >= 0.4


def test_stream_goes_on_after_a_failed_page_without_repeats(spark, service, tmp_path):
    def run():
        stream = spark.readStream.format("paged_json").option("url", service + "?page={page}").option("delay", 0.01).option("attempts", 1).option("pages_per_batch", 2).load()
        return stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    pages = lambda: sorted(r.page for r in spark.read.schema("page int, body string").parquet(f"{tmp_path}/out").collect())
    run().awaitTermination()
    first = pages()
    assert first == list(range(1, len(first) + 1)) and first
    Service.last = 9
    # The page is found, then fails when it is read.
    Service.refused = {}
    real = Service.do_GET
    seen = {"7": 0}

    def flaky(self):
        if "page=7" in self.path:
            seen["7"] += 1
            if seen["7"] == 2:
                return self.answer(500, "broken")
        return real(self)

    Service.do_GET = flaky
    try:
        failed = 0
        for _ in range(8):
            try:
                run().awaitTermination()
            except Exception:  # noqa: BLE001
                failed += 1
            if (tmp_path / "out").exists() and pages() == list(range(1, 10)):
                break
        assert failed == 1 and pages() == list(range(1, 10))
    finally:
        Service.do_GET = real


def test_tables_are_swapped_together(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "set")
    table = lambda n: spark.range(n)
    with pytest.raises(LookupError):
        manifest.read_tables(spark, root)
    assert manifest.commit_tables({"a": table(1), "b": table(2)}, root) == 1
    counts = lambda: {k: v.count() for k, v in manifest.read_tables(spark, root).items()}
    assert counts() == {"a": 1, "b": 2}
    # A crash while a table is written, after all are written, and within the manifest.
    broken = spark.range(3).select(F.raise_error(F.lit("crash")).alias("id"))
    with pytest.raises(Exception, match="crash"):
        manifest.commit_tables({"a": table(5), "b": broken}, root)
    assert counts() == {"a": 1, "b": 2}
    real = manifest._write_new

    def stop(*_):
        raise RuntimeError("crash")

    def torn(spark, path, body):
        real(spark, path, body[: len(body) // 2])
        raise RuntimeError("crash")

    for fault in (stop, torn):
        monkeypatch.setattr(manifest, "_write_new", fault)
        with pytest.raises(RuntimeError):
            manifest.commit_tables({"a": table(5), "b": table(6)}, root)
        assert counts() == {"a": 1, "b": 2}
    monkeypatch.setattr(manifest, "_write_new", real)
    reader = manifest.read_tables(spark, root)
    assert manifest.commit_tables({"b": table(7)}, root) == 3  # 2 is torn
    assert counts() == {"a": 1, "b": 7} and {k: v.count() for k, v in reader.items()} == {"a": 1, "b": 2}
    # The second of two writers.
    monkeypatch.setattr(manifest, "_taken", lambda *_: 2)
    with pytest.raises(manifest.VersionTaken):
        manifest.commit_tables({"a": table(9)}, root)
    monkeypatch.undo()
    assert counts() == {"a": 1, "b": 7}
    assert manifest.commit_tables({"a": table(4)}, root) == 4 and manifest.expire(spark, root, keep=1) == [1, 3]
    assert counts() == {"a": 4, "b": 7} and set(manifest.versions(spark, root)) == {4}


def test_zip_members_equal_plain_csv(spark, tmp_path):
    r = random.Random(1)
    rows = [{"id": i, "year": 1990 + i % 5, "make": r.choice(["Ford", 'Al"fa, R', "N/A", "é\nx"]), "model": f"m{i % 9}", "cost": r.choice(["1.5", "2", "", "NA"])} for i in range(2500)]
    rows[2200]["id"] = "late"  # does not fit what the first rows say
    texts = []
    for part in (rows[:1500], rows[1500:]):
        out = io.StringIO()
        w = csv.DictWriter(out, fieldnames=list(rows[0]))
        w.writeheader()
        w.writerows(part)
        texts.append(out.getvalue())
    (tmp_path / "plain").mkdir()
    with zipfile.ZipFile(tmp_path / "cat.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("b/two.csv", texts[1])
        z.writestr("a.CSV", texts[0])
        z.writestr("empty.csv", "id,year\n")
        z.writestr("readme.txt", "no")
    for i, t in enumerate(texts):
        (tmp_path / "plain" / f"{i}.csv").write_text(t)
    got = files.read_zip_csv(spark, str(tmp_path / "cat.zip"), infer_rows=600)
    assert dict(got.dtypes) == {"__member": "string", "__row": "bigint", "id": "bigint", "year": "bigint", "make": "string", "model": "string", "cost": "double"}
    plain = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "plain"))
    null = lambda c: F.when(~F.col(c).isin("", "NA", "N/A"), F.col(c))
    want = plain.select(null("id").try_cast("long").alias("id"), null("year").try_cast("long").alias("year"), null("make").alias("make"), null("model").alias("model"), null("cost").try_cast("double").alias("cost"))
    mine = got.select("id", "year", "make", "model", "cost")
    assert mine.count() == 2500 and mine.exceptAll(want).count() == 0 and mine.where("id is null").count() == 1
    members = {r[0].split("cat.zip/")[1]: (r[1], r[2]) for r in got.groupBy("__member").agg(F.count("*"), F.max("__row")).collect()}
    assert members == {"a.CSV": (1500, 1499), "b/two.csv": (1000, 999)}
    catalog = files.read_catalog(spark, str(tmp_path / "cat.zip"))
    assert catalog.count() == mine.where("id is not null and make is not null").count() and "normalized_make" in catalog.columns


def _stream(spark, folder):
    return spark.readStream.schema("k string, n long, a double, b double").option("maxFilesPerTrigger", 1).parquet(folder)


def _kept(rows):
    last, out = {}, []
    for k, n, a, b in rows:
        if last.get(k, ()) != (a, b):
            out.append((k, n, a, b))
        last[k] = (a, b)
    return out


def _rows(seed, start, count):
    r = random.Random(seed)
    return [(r.choice(["x", "y", None]), start + i, r.choice([1.0, 2.0, None]), r.choice([1.0, None])) for i in range(count)]


def test_append_loop_stops_when_idle_and_goes_on_later(spark, tmp_path):
    source, waits, every = f"{tmp_path}/in", [], []

    def add(seed):
        rows = _rows(seed, 1000 * seed, 60)
        every.extend(rows)
        spark.createDataFrame(rows, "k string, n long, a double, b double").coalesce(1).write.mode("append").parquet(source)

    def start():
        return changes.emit_changes_stream(_stream(spark, source), "k", "n", ("a", "b"), f"{tmp_path}/to", f"{tmp_path}/state")

    add(1)
    assert changes.append_until_idle(start, sleep=waits.append) == 60 and len(waits) == 2
    add(2)
    add(3)
    assert changes.append_until_idle(start, sleep=waits.append) == 120
    got = [tuple(r) for r in spark.read.schema("k string, n long, a double, b double").parquet(f"{tmp_path}/to/out/*").collect()]
    assert sorted(got, key=lambda r: r[1]) == _kept(every)
    assert len(list((tmp_path / "to" / "last").iterdir())) <= 2


def test_changes_kept_as_state(spark, tmp_path):
    source, every = f"{tmp_path}/in", []
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for seed in (1, 2):
            rows = _rows(seed, 1000 * seed, 50)
            every += rows
            spark.createDataFrame(rows, "k string, n long, a double, b double").coalesce(1).write.mode("append").parquet(source)
            out = changes.changes_by_state(_stream(spark, source), "k", "n", ("a", "b"))
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = [tuple(r) for r in spark.read.schema("k string, n long, a double, b double").parquet(f"{tmp_path}/out").collect()]
        assert sorted(got, key=lambda r: r[1]) == _kept(every)
    finally:
        spark.conf.set(name, before)
