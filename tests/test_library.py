import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fernlode import session
from fernlode.functions import text
from fernlode.library import Library
from fernlode.plans import management
from fernlode.sources import files, tables
from fernlode.streaming.ingest import ingest_stream, status_counts_stream


def _write(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return path


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    _write(d, "a.md", "﻿# Alpha Works\r\n\r\nThe Alpha Works and the Beta Group keep the pump schedule together.\r\n")
    _write(d, "b.txt", "检索配置中心保管借阅记录，并且每周核对一次清单内容与编号。".encode("gbk"))
    _write(d, "blank.md", " \n")
    _write(d, "broken.docx", b"no zip")
    _write(d, "password.txt", "secret")
    _write(d, "c.zip", b"x")
    return d


def test_lifecycle(spark, folder, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/kb", "works").create()
    assert lib.ingest(f"file://{folder}") == {"offered": 4, "skipped": 0, "done": 2, "failed": 2}
    docs = {r.name: r for r in lib.table("documents").collect()}
    assert docs["a.md"].text.startswith("# Alpha Works\n\n") and docs["b.txt"].text.startswith("检索配置")
    assert docs["broken.docx"].status == "failed" and docs["blank.md"].error_message == "no text"
    n = lib.table("chunks").count()
    assert n == lib.table("vec_index").count() == 2
    assert lib.ingest(f"file://{folder}")["skipped"] == 2
    assert lib.table("chunks").count() == n
    _write(folder, "a.md", "# Alpha Works\n\nAn entirely new text about the valve log, long enough to be one chunk.\n")
    assert lib.ingest(f"file://{folder}")["done"] == 1
    texts = [r.text for r in lib.table("chunks").collect()]
    assert len(texts) == 2 and any("valve log" in t for t in texts)
    assert [r.sources for r in lib.search("valve log", top_k=2, similarity=-1).collect()] == ["vector"] * 2
    lib.update_settings(bm25=True, mmr=True, graph=True)
    hit = lib.search("valve log", top_k=2).collect()
    assert "valve log" in hit[0].text and "bm25" in hit[0].sources
    for wrong in (lambda: lib.search(" "), lambda: lib.search("x", top_k=0), lambda: lib.search("x", top_k=1.5)):
        with pytest.raises(ValueError):
            wrong()
    lib.build_graph()
    assert lib.graph_stats()["entities"] >= 1
    entity = lib.table("entities").first()
    nodes, edges = lib.local_view(entity.id)
    assert edges.count() <= 160 and nodes.count() <= 81
    assert len(entity.embedding) == 64 and lib.table("entities").select("id").distinct().count() == lib.table("entities").count()
    cleaned = lib.clean_entities()
    assert cleaned["total"] == lib.graph_stats()["entities"] + cleaned["dropped"]
    assert lib.resume() == 0
    lib.write(documents=lib.table("documents").withColumn("graph_status", F.lit("processing")))
    assert lib.resume() == 4 and lib.resume() == 0
    path = next(r.path for r in lib.table("documents").collect() if r.name == "a.md")
    assert lib.delete_document(path) and not lib.delete_document(path)
    assert lib.table("chunks").count() == 1 and lib.graph_stats()["entities"] == 0
    for wrong in ({"topK": 20, "chunkTargetLength": 5}, {"bm25": 1}, {"topK": True}, {"color": 1}):
        with pytest.raises(ValueError):
            lib.update_settings(**wrong)
    assert lib.settings()["topK"] == 15 and not lib._state()["requiresRebuild"]
    assert lib.update_settings(chunkTargetLength=300) and lib._state()["requiresRebuild"]
    assert lib.rebuild() == 1 == lib.table("vec_index").count() and not lib._state()["requiresRebuild"]
    assert len(os.listdir(tmp_path / "kb" / "works" / "chunks")) <= 2  # older versions are gone
    assert lib.list_documents(1, 2).count() == 2
    lib.delete()
    assert not lib.exists()


def test_streaming_ingest(spark, folder, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/kb", "stream").create()
    for _ in range(2):
        ingest_stream(lib, f"file://{folder}", f"file://{tmp_path}/cp").awaitTermination(120)
    assert lib.table("chunks").count() == 2
    _write(folder, "later.md", "# Later\n\nThis page came later and is long enough to make a chunk of its own.\n")
    ingest_stream(lib, f"file://{folder}", f"file://{tmp_path}/cp").awaitTermination(120)
    assert lib.table("chunks").count() == 3


def test_streaming_counts(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as updated_at, 'ok' as status union all select timestamp'2024-01-01 00:50:00', 'ok' union all select null, 'ok'")
    rows.write.parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows")
    query = status_counts_stream(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.status, r.n) for r in spark.table("counts").collect()] == [("ok", 2)]


def test_settings_of_a_search():
    assert tables.distance_threshold({}) == 0.7 and tables.distance_threshold({"similarityThreshold": 0.4}) == 0.6
    assert tables.distance_threshold({"similarityThreshold": 0.4, "distanceThreshold": 0.2}) == 0.2
    assert tables.distance_threshold({"distanceThreshold": 0.2}, similarity=0.9) == pytest.approx(0.1)
    assert tables.distance_threshold({"distanceThreshold": 0.2}, distance=0.5, similarity=0.9) == 0.5
    assert tables.top_k({}) == 15 and tables.top_k({"topK": 7}) == 7 and tables.top_k({"topK": 7}, 3) == 3
    assert tables.features({"mmrEnabled": True, "bm25": False}) == {"graph": False, "bm25": False, "mmr": True}


def test_names_paths_and_services(spark):
    rows = [("notes/id_ed25519",), ("a/my-wallet.txt",), ("x/passwd",), ("库/密钥.md",), ("口令.txt",), ("access_token.md",), ("private_key.txt",), ("u/.kube/config.md",), ("u/.ssh/a.md",), ("keychain.md",), ("a/.env.md",), ("Credentials/a.md",)]
    df = spark.createDataFrame(rows + [("a/plain.md",), ("secretless/ok.md",)], "p string")
    assert [r[0] for r in df.select(text.sensitive_path(F.col("p"))).collect()] == [True] * 12 + [False] * 2
    names = spark.createDataFrame([("ａｂｃ",), ("  works ",), ("库",), ("a\x07b",), (" ",), (None,)], "n string")
    got = [r[0] for r in names.select(text.library_id(F.col("n"))).collect()]
    assert got[0] == "abc" and got[1] == "works" and got[2].startswith("kb-") and got[3:] == [None] * 3
    hosts = ["", None, "LOCALHOST", "a.localhost", "10.1.2.3", "172.20.0.1", "172.32.0.1", "[::1]", "0.0.0.0", "10.example.com", "a.example"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert [r[0] for r in df.select(text.private_host(F.col("h"))).collect()] == [True, True, True, True, True, True, False, True, True, False, False]
    assert text.fingerprint({}, "a", "m") == "empty" and text.fingerprint({"model": "m", "provider": "a", "dimensions": 8}, "a", "m", 8) is None
    assert text.fingerprint({"model": "m", "provider": "a", "dimensions": 8}, "a", "m", 9) == "dimensions differ"


def test_intermediate_tables_are_removed(spark):
    df = session.materialize(spark.range(3), "three")
    folder = df.inputFiles()[0].rsplit("/", 2)[0]
    assert df.count() == 3 and os.path.exists(folder.removeprefix("file://"))
    session.release(spark)
    assert not os.path.exists(folder.removeprefix("file://"))


def test_converters(tmp_path):
    w = 'xmlns:w="w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", doc)
    assert files.docx_markdown((tmp_path / "a.docx").read_bytes()) == "# Title\n\nText"
    sheet = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>项目</t></is></c><c r="C1" t="inlineStr"><is><t>收|入</t></is></c></row><row><c r="A2"><v>1</v></c></row><row/></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert files.xlsx_markdown((tmp_path / "a.xlsx").read_bytes()) == "# S\n\n| 项目 |  | 收\\|入 |\n| --- | --- | --- |\n| 1 |  |  |"
    page = files.html_markdown("<html><head><title>T</title><script>x()</script></head><body><nav>menu</nav><p>One two</p><ul><li>a</li></ul></body></html>", "https://a.example/")
    assert page.startswith("---\nsource: https://a.example/") and "# T" in page and "One two" in page and "- a" in page and "menu" not in page
    assert os.path.exists(tmp_path / "a.docx")


def test_hosts_of_odd_addresses(spark):
    """Addresses that Java's parser refuses, or has no host for."""
    want = {
        "https://A.Example:80/x": "a.example", "http\u200es://a.test/b": "", "https://www.a\u200b.example/w": "www.a\u200b.example", "https://a.ex\u0430mple/": "a.ex\u0430mple",
        "https://a_b.test?x": "a_b.test", "http://me@127.0.0.1/": "127.0.0.1", "http://[::1]:80/": "[::1]", "https://a.test/%zz[": "a.test", "no address": "", "https://": "",
    }
    df = spark.createDataFrame([(u,) for u in want], "u string")
    assert {r.u: r.h for r in df.select("u", text.url_host(F.col("u")).alias("h")).collect()} == want


def test_url_hosts_of_odd_addresses(spark, tmp_path):
    rows = [(1, "web", "---\nsource: http\u200es://a.test/b\n---\n"), (2, "web", "---\nsource: https://a.ex\u0430mple/c\n---\n"), (3, "web", "none")]
    spark.createDataFrame(rows, "doc_id long, fmt string, normalized_text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.host, r.private, r.fetchable) for r in management.url_hosts(spark, str(tmp_path)).collect()}
    assert got == {1: ("", True, False), 2: ("a.ex\u0430mple", False, True)}
