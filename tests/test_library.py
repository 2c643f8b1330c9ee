"""Library, map, validation, bibliographic and export functions that the registered queries do not reach."""

import json
import sys

import pytest
from pyspark.sql import functions as F

from lexatlas.functions import ids
from lexatlas.functions import text as T
from lexatlas.operators import biblio, explain, fts, library, maps, similarity, state, tfidf, validation
from lexatlas.sources import export, files, records


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_informative_terms(spark):
    cases = {"neural model": (True, True), "model": (False, False), "data model": (False, False), "2020": (False, True), "ab": (False, False), "ab cd": (False, False), "graph": (True, True), "abstract": (False, False), "model 12": (False, False), "2020 2021": (False, True), "": (False, False)}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: (r.a, r.b) for r in df.select("t", T.informative(F.col("t")).alias("a"), T.informative(F.col("t"), of_label=False).alias("b")).collect()}
    assert got == cases


def test_preview_and_match_excerpt(spark):
    df = spark.createDataFrame([("a \n b",), ("word " * 400,), (None,)], "t string")
    got = [r[0] for r in df.select(T.preview(F.col("t"), 12)).collect()]
    assert got == ["a b", "word word wo...", ""]
    one = spark.createDataFrame([("One two, Thrée four five six",)], "t string")
    shown = lambda *w, n=3: one.select(T.match_excerpt(F.col("t"), list(w), n)).first()[0]
    assert shown("three") == "One two, [Thrée] ... " and shown("six") == " ... four five [six]" and shown("none") == "One two, Thrée ... " and shown("one", n=9) == "[One] two, Thrée four five six"


def test_state_of_a_whole_run(spark):
    old = spark.createDataFrame([("c", p, s, st, "f", "t-" + p, "t0", "t0", "t0") for p, s, st in (("a", "1", "active"), ("b", "1", "active"), ("d", "1", "unindexed"), ("e", "1", "active"), ("g", "1", "unindexed"))], "corpus_id string, relative_path string, sha256 string, status string, fingerprint string, text string, first_seen_at string, last_seen_at string, updated_at string")
    scan = spark.createDataFrame([("c", "a", "1", "f", None, 100, "n", "text"), ("c", "b", "2", "f", None, 100, "n", "text"), ("c", "d", "1", "f", "OCR is off", None, None, None), ("c", "x.png", "1", "f", "OCR is off", None, None, None), ("c", "y", "1", "f", None, 9, "n", "text"), ("c", "z", "1", "f", None, 100, "n", "text")], "corpus_id string, relative_path string, sha256 string, fingerprint string, skip_reason string, char_count long, text string, method string")
    merged = state.classify(old, scan)
    got = {r.relative_path: (r.status, r.sha256, r.text, r.first_seen_at, r.last_seen_at, r.updated_at) for r in state.next_documents(merged, "t1").collect()}
    assert got == {
        "a": ("active", "1", "t-a", "t0", "t1", "t0"), "b": ("active", "2", "n", "t0", "t1", "t1"), "d": ("unindexed", "1", "t-d", "t0", "t1", "t1"), "e": ("missing", "1", "t-e", "t0", "t0", "t1"),
        "g": ("unindexed", "1", "t-g", "t0", "t0", "t0"), "z": ("active", "1", "n", "t1", "t1", "t1"),
    }
    said = {r.relative_path: (r.status, r.method) for r in state.reports(merged, "r").collect()}
    assert said == {"a": ("extracted", "unchanged"), "b": ("extracted", "text"), "d": ("skipped", "unknown"), "x.png": ("ocr_unavailable", "image-ocr-tesseract"), "y": ("unindexed", "text"), "z": ("extracted", "text")}
    run = state.run_row(merged, spark.createDataFrame([(5,), (7,)], "char_count long"), "r", "t0", "t1").first()
    assert (run.files_seen, run.inserted, run.updated, run.unchanged, run.skipped, run.low_text, run.missing, run.chunks_indexed, run.characters_indexed, run.active_documents) == (6, 1, 1, 1, 3, 1, 1, 2, 12, 3)


def test_attachments_without_a_data_folder(spark):
    a = spark.createDataFrame([("k1", None, None), ("k2", "storage:a.pdf", None), ("k3", "/x/y.pdf", None), ("k4", "sub/y", None), ("k5", None, "f.pdf"), ("k6", "/x/z.pdf", None), ("k7", "storage:", None)], "attachment_key string, path string, filename string")
    there = spark.createDataFrame([("/x/y.pdf",)], "path string")
    got = {r.attachment_key: r.path_status for r in biblio.resolve_attachments(a, there).collect()}
    assert got == {"k1": "no_local_file", "k2": "missing", "k3": "resolved", "k4": "missing", "k5": "unsupported", "k6": "missing", "k7": "missing"}
    assert {r.attachment_key: r.path_status for r in biblio.resolve_attachments(a, there, "/data").collect()}["k7"] == "unsupported"
    assert {r.attachment_key: r.path_status for r in biblio.resolve_attachments(a, there, "/data").collect()}["k3"] == "linked_outside_data_dir"


def test_validations():
    assert biblio.library_prefix(" /Users/0 ") == "/users/0" and biblio.library_prefix("local") == "/users/0"
    for wrong in (lambda: biblio.library_prefix("groups/1"), lambda: biblio.non_empty(("a", " "), "--tag"), lambda: library.row_counts(passwords=None), lambda: maps.saved_run("m", None, None, "s", "t", [], "dense"), lambda: explain.manual_label(" ")):
        with pytest.raises(ValueError):
            wrong()


def test_collections_that_nest_deep_or_in_cycles(spark):
    deep = [(str(k), f"n{k}", str(k + 1) if k < 1500 else None) for k in range(1501)]
    wheel = [(f"w{k}", f"W{k}", f"w{(k + 1) % 5}") for k in range(5)] + [("self", "S", "self"), ("t1", "T1", "w3"), ("t2", "T2", "t1"), ("u", "U", "self")]

    def path(of, key):
        names, seen = [], set()
        while key in of and key not in seen:
            seen.add(key)
            names.append(of[key][0])
            key = of[key][1]
        return " / ".join([*[key] * (key in seen), *names[::-1]])

    for data in (deep, wheel, deep[-3:] + wheel, deep[:1], []):
        of = {k: (n, p) for k, n, p in data}
        got = dict(rows(biblio.collection_paths(spark.createDataFrame(data, "key string, name string, parent string"))))
        assert got == {k: path(of, k) for k in of}


def test_validation_status(spark):
    dangling = lambda n: spark.createDataFrame([("a", n)], "code string, n long")
    runs = spark.createDataFrame([], "run_id long")
    stale = spark.createDataFrame([("s",)], "signature string")
    ok = validation.status(validation.issues(dangling(0), runs))
    warned = validation.status(validation.issues(dangling(0), runs, stale))
    wrong = validation.status(validation.issues(dangling(2), runs, stale))
    assert [x.first()["status"] for x in (ok, warned, wrong)] == ["OK", "WARNINGS", "ERRORS"]
    assert [validation.exit_code(x) for x in (ok, warned, wrong)] == [0, 0, 1] and validation.exit_code(warned, strict=True) == 1


@pytest.fixture(scope="module")
def docs(spark):
    words = {0: "graph theory vertex edge", 1: "graph vertex colour", 2: "kitchen recipe bread", 3: "bread oven recipe flour", 4: ""}
    return spark.createDataFrame([(i, f"p/{i}.txt", " ".join([w] * 6)) for i, w in words.items()], "doc_id long, relative_path string, text string")


def test_a_map_from_documents_to_a_page(spark, docs, tmp_path):
    points, clusters, warnings = maps.build(docs, limit=10, neighbours=2)
    got = {r.doc_id: r for r in points.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and warnings == [] and got[0].neighbours[0].neighbour == 1 and got[2].neighbours[0].neighbour == 3 and got[4].top_terms == []
    assert all(-1 <= r.x <= 1 and r.cluster_label for r in got.values()) and sum(r.size for r in clusters.collect()) == 5
    assert maps.build(docs, limit=2)[2] == ["the first 2 of 5 documents because of limit=2"]
    assert maps.build(docs.where("false"))[2] == ["no active indexed documents"]
    table = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("t").alias("updated_at"), F.length("text").alias("char_count"))
    sign = lambda t, **p: maps.set_signature(t, **p).first()[0]
    assert sign(table, seed=1) == sign(table.orderBy(F.desc("document_id")).repartition(3), seed=1) != sign(table, seed=2)
    run = maps.saved_run("m", points, clusters, sign(table), "2024", warnings)
    header = run["map_runs"].first()
    assert header.document_count == 5 and header.run_id.startswith("map_run_") and {r.run_id for r in run["map_points"].collect()} == {header.run_id}
    present = spark.createDataFrame([(0, "p/0.txt", "active")], "document_id long, relative_path string, status string")
    assert maps.missing_points(maps.run_documents(run["map_points"], present, header.run_id)) == ["4 saved map point(s) no longer match a current document"]
    assert maps.delete_run(run, header.run_id)["map_clusters"].isEmpty()
    payload = export.map_json(points, clusters, warnings)
    assert len(json.loads(payload)["points"]) == 5 and "</script" not in export.map_html(payload + "</script>").split('id="map">')[1].split("</script>")[0]
    with pytest.raises(ValueError):
        export.map_json(points, clusters, [], most=3)
    lines = export.documents_json(docs, points.select("doc_id", "x", "y"))
    assert all("text" not in json.loads(r.value) for r in lines.collect())
    export.write_json(lines, f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 5


def test_overrides_name_clusters(spark, docs):
    clustered = docs.withColumn("cluster_id", F.when(F.col("doc_id") < 2, 0).otherwise(1))
    plain = {r.cluster_id: r for r in maps.label_clusters(clustered).collect()}
    manual = spark.createDataFrame([(plain[0].signature, "mine")], "signature string, manual_label string")
    named = {r.cluster_id: (r.display_label, r.source) for r in maps.label_clusters(clustered, manual).collect()}
    assert named[0] == ("mine", "manual") and named[1] == (plain[1].generated_label, "generated")


def test_pairs_without_anything_in_common(spark):
    pairs = spark.createDataFrame([(1, "source", "graph vertex"), (1, "target", "bread oven"), (2, "source", "graph vertex"), (2, "target", "graph oven")], "pair_id long, side string, text string")
    got = {r.pair_id: r for r in maps.explain_pairs(pairs).collect()}
    assert got[1].lexical_score == 0 and got[1].warnings == ["no shared terms", "no matching chunks"] and got[1].shared_terms is None
    assert 0 < got[2].lexical_score < 1 and [t.term for t in got[2].shared_terms] == ["graph"] and got[2].warnings == []


def test_backup_is_checked(spark, docs, tmp_path):
    folder = f"{tmp_path}/backup"
    listed = export.backup({"documents": docs, "more": docs.limit(1)}, folder)
    assert listed.count() == export.checksums(spark, f"{folder}/data").count() > 1 and export.inspect(spark, folder).isEmpty()
    assert export.restore(spark, folder, f"{tmp_path}/back")["documents"].count() == 5
    assert export.restore(spark, folder, f"{tmp_path}/back", dry_run=True)["more"].count() == 1
    victim = next((tmp_path / "backup/data/more").glob("part-*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    victim.with_name(f".{victim.name}.crc").unlink()
    with pytest.raises(ValueError):
        export.restore(spark, folder, f"{tmp_path}/again")


def test_snapshots_are_published_by_numbers(spark, docs, tmp_path):
    folder = f"{tmp_path}/snap"
    with pytest.raises(FileNotFoundError):
        files.current(spark, folder)
    files.publish({"documents": docs}, folder)
    files.publish({"documents": docs.limit(2)}, folder)
    assert files.current(spark, folder)["documents"].count() == 2


def test_scan_leaves_out_what_it_should(spark, tmp_path):
    for name in ("a.txt", "build/b.md", "dist/c.TXT", "venv/d.txt", "node_modules/e.txt", ".hidden/f.txt", "g.bmp", "h.pdf", "x/y/i.tex", "j.png"):
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("text " * 30)
    found = lambda **k: sorted(r.relative_path for r in files.discover(spark, f"{tmp_path}/corpus", **k).select("relative_path").collect())
    assert found() == ["a.txt", "build/b.md", "dist/c.TXT", "h.pdf", "x/y/i.tex"]
    assert found(pdf=False, images=True) == ["a.txt", "build/b.md", "dist/c.TXT", "j.png", "x/y/i.tex"]


def test_ids(spark):
    import hashlib

    digest = lambda *p: hashlib.sha256("\0".join(p).encode()).hexdigest()[:16]
    r = spark.range(1).select(ids.report_id(F.lit("r"), F.lit("p"), F.lit("s")), ids.vector_id(F.lit("m"), F.lit("document"), F.lit("d")), ids.item_id(F.lit("s"), F.lit("K"))).first()
    assert tuple(r) == ("extract_" + digest("r", "p", "s"), "vec_" + digest("m", "document", "d"), "zotero_item_" + digest("s", "K"))


def service(telling):
    class Service:
        """Seven records a kind, by page; one that tells the total, or one whose pages are linked."""

        def __init__(self, telling):
            self.telling = telling

        def page(self, path, start, size, since=None):
            rows = [{"key": f"{path}{i}", "version": i} for i in range(7) if since is None or i > since]
            end = start + size
            return records.Page(rows[start:end], len(rows) if self.telling else None, f"{path} {end} {size}" if not self.telling and end < len(rows) else None)

        def follow(self, address):
            path, start, size = address.split(" ")
            return self.page(path, int(start), int(size))

    return Service(telling)


@pytest.mark.parametrize("telling", [True, False])
def test_records_are_fetched_page_by_page(spark, telling):
    got = lambda **k: [json.loads(r.json)["version"] for r in records.fetch(spark, service(telling), "items", page_size=3, **k).collect()]
    assert sorted(got()) == list(range(7)) and sorted(got(limit=4)) == [0, 1, 2, 3] and got(limit=0) == []
    if telling:
        assert sorted(got(since=4)) == [5, 6] and records.count(service(True), "children", "K") == 7
    assert json.loads(records.fetch(spark, service(telling), "children", "K", limit=1).first().json)["key"] == "/items/K/children0"


def test_record_service_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.send_header("Total-Results", "2")
            self.send_header("Link", '<http://x/a>; rel="first", <http://x/b>; rel="next"')
            self.end_headers()
            self.wfile.write(b'{"no": "list"}' if "tags" in self.path else json.dumps([{"path": self.path}, 3]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = records.HttpClient(f"http://127.0.0.1:{server.server_port}/")
    page = client.page("/items", -1, 5, since=3)
    assert page == records.Page([{"path": "/users/0/items?start=0&limit=5&since=3"}], 2, "http://x/b")
    with pytest.raises(records.RecordError):
        client.page("/tags", 0, 1)
    server.shutdown()
    with pytest.raises(records.RecordError):
        records.HttpClient("http://127.0.0.1:1").page("/items", 0, 1)


def test_import_orchestration(spark):
    items = spark.createDataFrame(
        [("A", 1, "book", ["x"], ["c"], "long text " * 20, True, True, "pdf"), ("B", 5, "book", ["x", "y"], ["c"], "short", True, False, ""), ("C", 9, "note", [], [], "long text " * 20, False, False, "")],
        "item_key string, version long, item_type string, tags array<string>, collections array<string>, text string, has_pdf boolean, pdf_resolved boolean, pdf_text string",
    )
    known = spark.createDataFrame([("A", "old")], "item_key string, sha256 string")
    files_ = spark.createDataFrame([("A", "storage:a.pdf", "resolved"), ("B", "/b.pdf", "missing")], "item_key string, path string, path_status string")
    notes = spark.createDataFrame([("A", "note"), ("C", "annotation")], "item_key string, kind string")
    run = lambda **k: biblio.import_library(items, known, files_, notes, **k)
    out = run()
    c = out["counters"].first()
    assert (c.items_seen, c.items_imported, c.items_updated, c.pdfs_missing, c.metadata_only_documents, c.attachments_resolved, c.notes_imported) == (3, 2, 1, 1, 2, 1, 1)
    assert out["cursor"].first()[0] == 9 and {r.item_key for r in out["written"].collect()} == {"A", "B", "C"} and "written" not in run(dry_run=True)
    outcomes = lambda **k: {r.item_key: r.outcome for r in run(**k)["outcomes"].collect()}
    assert outcomes(tags=("x",), since=1) == {"B": "imported"} and outcomes(item_types=("note, book",), collection="c", limit=1) == {"A": "updated"}
    assert outcomes(pdf_policy="skip-missing", metadata_only=False) == {"A": "updated", "B": "skipped", "C": "imported"}
    for wrong in ({"pdf_policy": "x"}, {"tags": (" ",)}):
        with pytest.raises(ValueError):
            run(**wrong)


def test_terms_of_a_corpus_without_others(spark):
    of = lambda *texts: {(r.doc_id, r.term) for r in tfidf.weights(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert of("the a", "a", None) == {(0, "the"), (0, "a"), (0, "the a"), (1, "a")} and of("", None) == set()
    assert of("the graph", "a") == {(0, "graph")}


def test_ranking_of_words_by_list_and_frame(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "c"), (4, None)], "doc_id long, text string")
    both = [rows(fts.bm25(docs, w).withColumn("score", F.round("score", 9))) for w in (["a", "b", "b"], spark.createDataFrame([("a",), ("b",), (None,)], "term string"))]
    assert both[0] == both[1] and [i for i, _ in both[0]] == [1, 2] and rows(fts.bm25(docs, [])) == []
    tokens = docs.select("doc_id", T.fts_tokens(F.col("text")).alias("t"))
    assert tokens.where(fts.matches(fts.Query("phrase", [], prefix=True), ["t"])).isEmpty() and tokens.where(fts.matches(fts.Query("phrase", ["b", "a"]), ["t"])).count() == 1
    with pytest.raises(ValueError):
        fts.bm25(docs, [f"w{k}" for k in range(fts.MOST_TERMS + 1)])


def test_project_settings(spark, tmp_path):
    files.init_project(spark, f"{tmp_path}/p", " mine ", map_seed="7")
    assert files.project(spark, f"{tmp_path}/p") == {"project_name": "mine", "map_seed": "7"}
    with pytest.raises(Exception):
        files.init_project(spark, f"{tmp_path}/p", "other")
    files.init_project(spark, f"{tmp_path}/p", "other", force=True)
    assert files.project(spark, f"{tmp_path}/p")["project_name"] == "other"
    with pytest.raises(ValueError):
        files.init_project(spark, f"{tmp_path}/q", " ")


def test_demo_pages_hide_ids_and_stamps(spark, docs):
    points = spark.createDataFrame([(0, 0.5, [(1, 0.9), (2, 0.1)]), (1, 0.1, [])], "doc_id long, x double, neighbours array<struct<neighbour:long,score:double>>")
    shown, places = export.demo(docs.withColumn("text", F.repeat("text", 4)), points)
    ids_ = {r.relative_path: r.document_id for r in shown.collect()}
    got = {r.document_id: [n.document_id for n in r.neighbours or []] for r in places.collect()}
    assert got == {ids_["p/0.txt"]: [ids_["p/1.txt"], ids_["p/2.txt"]], ids_["p/1.txt"]: []} and max(len(r.excerpt) for r in shown.collect()) == 160
    line = json.loads(export.payload_lines(shown).first().value)
    assert list(line) == ["document_id", "excerpt", "relative_path", "updated_at"] and line["updated_at"] == "synthetic-demo"


def test_maps_of_a_scan_and_of_reading(spark):
    scanned = spark.createDataFrame([("a", "graph vertex edge " * 9, None), ("b", "graph vertex colour " * 9, None), ("c", "tiny", None), ("d", None, "unsupported")], "relative_path string, text string, skip_reason string")
    points, clusters, warnings, skipped = maps.scan_map(scanned)
    assert points.count() == 2 and rows(skipped) == [("c", "text is too short"), ("d", "unsupported")]
    items = spark.createDataFrame([("A", "t", "read"), ("B", "u", "unknown")], "item_key string, title string, reading_status string").withColumn("abstract", F.lit(None).cast("string"))
    tags = spark.createDataFrame([("A", "x")], "item_key string, tag string")
    member = spark.createDataFrame([("A", "c"), ("B", "c")], "item_key string, collection_key string")
    cols = spark.createDataFrame([("c", "Name", "Top / Name")], "key string, name string, path string")
    links = spark.createDataFrame([("A", 1), ("B", 2)], "item_key string, document_id long")
    documents = spark.createDataFrame([(1, "p1", "active", "graph vertex"), (2, "p2", "active", "bread oven")], "document_id long, relative_path string, status string, text string")
    of = lambda **k: sorted(r.doc_id for r in maps.reading_map(items, tags, member, cols, links, documents, documents, **k)[0].collect())
    assert of() == [1, 2] and of(status="unknown") == [2] and of(tag="x", collection="name") == [1] and of(tag="y") == []
    one = spark.range(1).select(maps.reading_run_id(F.lit("n"), F.lit("s"), seed=1).alias("a"), maps.reading_run_id(F.lit("n"), F.lit("s"), seed=1).alias("b"), maps.reading_run_id(F.lit("n"), F.lit("s"), seed=2).alias("c")).first()
    assert one.a == one.b != one.c


def test_pdf_files_by_the_optional_library(spark, monkeypatch):
    import types

    from lexatlas.sources import extract

    assert {r.id: r.available for r in extract.extractors(spark).collect()}["extractor.markdown"]

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text is None:
                raise ValueError("broken")
            return self.text

    def reader(pages, title=None, encrypted=False):
        return lambda content: types.SimpleNamespace(is_encrypted=encrypted, decrypt=lambda password: 0, pages=[Page(p) for p in pages], metadata=types.SimpleNamespace(title=title))

    module = types.ModuleType("pypdf")
    monkeypatch.setitem(sys.modules, "pypdf", module)
    monkeypatch.setattr(extract, "find_spec", lambda name: True)
    module.PdfReader = reader(["word " * 100, None], " Title ")
    got = extract.extract("a/b.pdf", b"x")
    assert got["title"] == "Title" and got["text"] == ("word " * 100).strip() and len(got["warnings"]) == 1 and '"extraction_quality": "ok"' in got["metadata"]
    module.PdfReader = reader(["x"])
    assert "scanned" in extract.extract("a/b.pdf", b"x")["warnings"][-1]
    module.PdfReader = reader(["word " * 100], encrypted=True)
    got = extract.extract("a/b.pdf", b"x")
    assert got["skip_reason"] is None and got["text"] and got["warnings"] == ["encrypted PDF; text extraction may be incomplete"] and '"encrypted": true' in got["metadata"]
    module.PdfReader = lambda content: 1 / 0
    assert extract.extract("a/b.pdf", b"x")["skip_reason"].startswith("PDF extraction failed")


def test_records_as_a_data_source(spark, tmp_path):
    import json
    import threading
    import urllib.parse
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from lexatlas.sources import records

    held = {f"K{k}": {"key": f"K{k}", "version": k + 1} for k in range(25)}
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            asked.append(q)
            chosen = sorted((r for r in held.values() if r["version"] > q.get("since", -1)), key=lambda r: r["version"])
            self.send_response(200)
            self.send_header("Total-Results", str(len(chosen)))
            self.send_header("Last-Modified-Version", str(max(r["version"] for r in held.values())))
            self.end_headers()
            self.wfile.write(json.dumps(chosen[q["start"] : q["start"] + q["limit"]]).encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    records.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"base": f"http://127.0.0.1:{server.server_port}", "page_size": "10"}
    rows = spark.read.format("records").options(**options).load()
    assert rows.rdd.getNumPartitions() == 3 and sorted(json.loads(r.json)["key"] for r in rows.collect()) == sorted(held)
    asked.clear()
    assert sorted(r.version for r in rows.where("version > 20").collect()) == [21, 22, 23, 24, 25] and all(q["since"] == 20 for q in asked)

    def run():
        stream = spark.readStream.format("records").options(**options).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.version for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(1, 26))
    held["K3"] = {"key": "K3", "version": 26}
    held["new"] = {"key": "new", "version": 27}
    assert run() == list(range(1, 28)) and run() == list(range(1, 28))
    server.shutdown()


def test_encoders_from_afar_are_refused(spark, monkeypatch, tmp_path):
    import pickle
    import types

    with pytest.raises(similarity.ModelError):
        similarity.load_encoder("someone/model")
    with pytest.raises(similarity.ModelError):
        similarity.load_encoder(str(tmp_path))  # the library is not there
    made = []
    module = types.ModuleType("sentence_transformers")
    module.SentenceTransformer = lambda name: made.append(name) or types.SimpleNamespace(get_sentence_embedding_dimension=lambda: 2, encode=lambda texts, show_progress_bar: [[len(t), 1.0] for t in texts])
    monkeypatch.setitem(sys.modules, "sentence_transformers", module)
    encoder = similarity.load_encoder(str(tmp_path))
    assert encoder.dimension == 2 and made == [str(tmp_path.resolve())] and encoder.encode(["abc"]).tolist() == [[3.0, 1.0]]
    assert pickle.loads(pickle.dumps(encoder)).name == encoder.name and similarity.load_encoder("someone/model", allow_download=True).name == "someone/model"


def test_order_without_regard_to_case_folds_ascii(spark):
    paths = spark.createDataFrame([("i", k) for k in "abcd"], "item_key string, collection_key string")
    named = spark.createDataFrame([("a", "Éb", None), ("b", "ec", None), ("c", "ED", None), ("d", "éa", None)], "key string, name string, path string")
    assert biblio.collections_of(paths, named).first().paths == ["ec", "ED", "Éb", "éa"]
