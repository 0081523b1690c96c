import json

import pytest
from pyspark.sql import functions as F

from mapwright.functions import text as T
from mapwright.operators import chunking as C
from mapwright.operators import evaluation as E
from mapwright.operators import export as X
from mapwright.operators import harmonize as H
from mapwright.operators import judging as J
from mapwright.operators import layout as L
from mapwright.operators import retrieval as R
from mapwright.operators import verdicts as V
from mapwright.operators.store import ChunkStore, cache_key, with_cache
from mapwright.sources import catalog as S
from mapwright.streaming.upsert import upsert_stream

BLOCKS = "doc string, page int, pos int, x0 double, y0 double, x1 double, y1 double, text string"


def blocks(spark, rows):
    return spark.createDataFrame([("d", *r) for r in rows], BLOCKS)


def test_layouts(spark):
    def layout(xs, width):
        rows = [(1, i, x, i * 20.0, x + width, i * 20.0 + 10, "t") for i, x in enumerate(xs)]
        return L.detect_layout(blocks(spark, rows), ["doc", "page"]).first()["layout"]

    assert layout([50.0, 52.0], 400.0) == "single_column"
    assert layout([50.0, 320.0], 200.0) == "dual_column"
    assert layout([50.0, 320.0], 100.0) == "table"
    assert layout([50.0, 200.0, 350.0], 200.0) == "table"


def test_recurring_text_is_header_or_footer(spark):
    rows = []
    for page in (1, 2):
        rows += [(page, page * 10, 50.0, 20.0, 90.0, 30.0, "Policy"), (page, page * 10 + 1, 50.0, 100.0, 90.0, 110.0, f"body {chr(64 + page)}"), (page, page * 10 + 2, 50.0, 780.0, 90.0, 790.0, f"Page {page}")]
    got = {r["pos"]: r["role"] for r in L.classify_blocks(blocks(spark, rows), "doc", "page").collect()}
    assert got == {10: "header", 11: "body", 12: "footer", 20: "header", 21: "body", 22: "footer"}


def test_left_column_first(spark):
    rows = [(1, 0, 320.0, 10.0, 400.0, 20.0, "r1"), (1, 1, 50.0, 30.0, 200.0, 40.0, "l2"), (1, 2, 50.0, 10.0, 200.0, 20.0, "l1")]
    got = L.order_by_columns(blocks(spark, rows), "doc", "page").orderBy("place").collect()
    assert [r["text"] for r in got] == ["l1", "l2", "r1"]


def test_paragraphs_join_and_headers_stand(spark):
    rows = [(1, 0, 50.0, 10.0, 90.0, 22.0, "Section 1: Scope"), (1, 1, 50.0, 26.0, 90.0, 38.0, "First line"), (1, 2, 51.0, 42.0, 90.0, 54.0, "goes on."), (1, 3, 50.0, 300.0, 90.0, 312.0, "Far away."), (1, 4, 50.0, 320.0, 90.0, 332.0, "Page 3")]
    got = C.join_paragraphs(blocks(spark, rows), "doc", "pos").orderBy("paragraph").collect()
    assert [r["text"] for r in got] == ["Section 1: Scope", "First line goes on.", "Far away."]
    parts = C.sections(C.join_paragraphs(blocks(spark, rows), "doc", "pos"), "doc").collect()
    assert [(r["header"], r["sentences"]) for r in parts] == [("Section 1: Scope", ["First line goes on.", "Far away."])]


def test_all_boilerplate_gives_nothing(spark):
    assert C.chunk_documents(blocks(spark, [(1, 0, 1.0, 1.0, 2.0, 2.0, "Page 1")]), "doc", "pos").count() == 0


def test_chunks_take_one_shuffle_and_no_vectors(spark):
    text = ["Alpha beta gamma delta epsilon zeta eta theta iota.", "Alpha beta gamma delta epsilon zeta eta theta kappa.", "Nothing of it is shared by these other words here.", "!!! ... ???", "Alpha beta gamma delta epsilon zeta eta theta kappa."]
    rows = [(1 + i // 4, i, 50.0 + 300 * (i % 2), 60.0 + 40 * i, 90.0, 70.0 + 40 * i, t) for i, t in enumerate(text)]
    body = L.order_by_columns(L.classify_blocks(blocks(spark, rows), "doc", "page").where("role = 'body'").drop("role"), "doc", "page")
    chunks = C.chunk_documents(body, "doc", least=5)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "array<array<double>>" not in plan and "Join" not in plan
    assert sorted(chunks.collect()) == sorted(C.chunk_documents(body, "doc", embedder=R.embedding_of_each(), least=5).collect()) != []


def test_cosines_of_neighbours_are_those_of_the_vectors(spark):
    texts = [["One two two.", "two one", "", "??", "three three one two"], [], ["alone"]]
    frame = spark.createDataFrame([(t,) for t in texts], "t array<string>").withColumn("c", R.neighbour_cosines()(F.col("t"))).withColumn("v", R.embedding_of_each()(F.col("t")))
    for r in frame.withColumn("e", F.transform("t", lambda x, i: F.when(i > 0, T.cosine(F.get("v", i - 1), F.get("v", i))))).collect():
        assert r["c"] == r["e"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (C.merge_short, ["a" * 60, "bb", "c" * 50], ["a" * 60 + " bb", "c" * 50]),
        (C.merge_short, ["bb", "c" * 50], ["bb " + "c" * 50]),
        (C.merge_short, ["a", "b"], ["a b"]),
        (C.merge_short, [], []),
        (C.heal, ["It must be kept in", "The safe."], ["It must be kept in The safe."]),
        (C.heal, ["It is open", "and goes along", "Done."], ["It is open and goes along", "Done."]),
        (C.heal, ["Closed.", "lower"], ["Closed.", "lower"]),
        (C.heal, ["x" * 90, "lower"], ["x" * 90, "lower"]),
        (C.heal, ["  ", "a"], ["a"]),
    ],
)
def test_repairs(spark, f, given, expected):
    assert spark.createDataFrame([(given,)], "t array<string>").select(f(F.col("t")).alias("x")).first()["x"] == expected


def test_semantic_chunks_with_overlap(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "s array<string>, v array<array<double>>")
    got = frame.select(C.semantic_chunks(F.col("s"), F.col("v")).alias("n"), C.semantic_chunks(F.col("s"), F.col("v"), overlap=1).alias("o")).first()
    assert got["n"] == ["a b", "c"] and got["o"] == ["a b", "b c"]


def test_votes(spark):
    rows = [(1, 0, "fully_compliant", 0.9), (1, 1, "non_compliant", 0.6), (2, 0, "fully_compliant", 0.8), (2, 1, "fully_compliant", 0.8), (2, 2, "non_compliant", 1.0)]
    got = {r["c"]: (r["level"], r["pos"]) for r in V.best_rationale(spark.createDataFrame(rows, "c int, pos int, level string, confidence double"), "c").collect()}
    assert got == {1: ("non_compliant", 1), 2: ("fully_compliant", 0)}


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"type":"MappingRationale","is_compliant":true,"confidence_score":0.9,"explanation":"e"}', ("MappingRationale", "fully_compliant", True)),
        ('{"type":"MappingRationale","is_compliant":true,"compliance_level":"fully_compliant","confidence_score":0.5,"explanation":"e"}', ("MappingRationale", "partially_compliant", True)),
        ('{"type":"MappingRationale","is_compliant":false,"compliance_level":"fully_compliant","confidence_score":0.9,"explanation":"e"}', ("MappingRationale", "non_compliant", False)),
        ('{"type":"MappingRationale","is_compliant":true,"confidence_score":0.9,"explanation":"e","sub_requirements":[{"covered":true},{"covered":false}]}', ("MappingRationale", "partially_compliant", True)),
        ('{"type":"MappingRationale","is_compliant":true,"confidence_score":0.0,"explanation":""}', ("InsufficientEvidence", None, None)),
        ('{"type":"MappingRationale","is_compliant":"yes","confidence_score":0.9,"explanation":"e"}', None),
        ('{"type":"InsufficientEvidence","reason":"r"}', None),
        ('{"type":"Odd"}', ("InsufficientEvidence", None, None)),
        ("[1, 2]", None),
        ("nothing", None),
    ],
)
def test_answers(spark, raw, expected):
    v = spark.createDataFrame([(raw,)], "r string").select(V.parse_answer(F.col("r")).alias("v")).first()["v"]
    assert (v and (v["kind"], v["compliance_level"], v["is_compliant"])) == expected


def test_batches_pad_and_drop(spark):
    raw = 'ok [{"type":"InsufficientEvidence","reason":"r","required_context":"c"}, 5, {"type":"MappingRationale"}]'
    frame = spark.createDataFrame([(1, 4, raw), (2, 1, raw), (3, 2, "no list")], "k int, n int, raw string")
    got = [(r["k"], r["pos"], r["verdict"]["reason"]) for r in V.parse_batch(frame, "raw", "n", ["k"]).orderBy("k", "pos").collect()]
    assert got == [(1, 0, "r"), (1, 1, "Invalid batch element: not a JSON object."), (1, 2, "Failed to parse batch element."), (1, 3, "Missing batch element in LLM response."), (2, 0, "r")]


def test_siblings(spark):
    rows = [("1.1", True, None, None, 0), ("1.2", False, "fully_compliant", 0.9, 1), ("1.3", False, "non_compliant", 0.7, 2), ("2.1", True, None, None, 3), ("3.1", True, None, None, 4), ("3.2", False, "non_compliant", 0.4, 5)]
    got = {r["control_id"]: (r["resolved_level"], r["resolved_confidence"], r["explanation"]) for r in V.resolve_siblings(spark.createDataFrame(rows, "control_id string, is_meta boolean, level string, confidence double, pos int")).collect()}
    assert got["1.1"][:2] == ("partially_compliant", 0.8) and "Gaps remain in 1.3." in got["1.1"][2]
    assert got["2.1"] == (None, None, None)
    assert got["3.1"][:2] == ("non_compliant", 0.9)
    assert got["1.2"] == ("fully_compliant", 0.9, None)


def test_clusters_are_single_linkage(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.28, 0.96]), (4, [-1.0, 0.0]), (5, [0.0, 0.0])]
    got = {r["k"]: r["cluster"] for r in H.cluster(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", 0.79).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_fusion_needs_both_lists_for_a_high_score(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 12, 2)], "q int, d int, rank int")
    got = [(r["d"], round(r["score"], 3)) for r in R.fuse(a, b, "q", "d", 5).orderBy("rank").collect()]
    assert got == [(10, 1.0), (11, 0.492), (12, 0.492)]


def test_vector_top_in_blocks_and_filtered(spark, monkeypatch):
    frame = spark.createDataFrame([(i, [float(i % 5), 1.0], i % 2) for i in range(40)], "d long, v array<double>, label int")
    queries = frame.select(F.col("d").alias("q"), "v").where("q < 9")
    whole = R.vector_top(frame, queries, "d", "v", "q", "v", 3, {"label": 1}).orderBy("q", "rank").collect()
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    assert R.vector_top(frame, queries, "d", "v", "q", "v", 3, {"label": 1}).orderBy("q", "rank").collect() == whole
    assert all(r["d"] % 2 for r in whole)


def test_store_upserts_and_filters(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    kind = "chunk_id string, document_name string, embedding array<float>, extraction_order int"
    assert store.index("chunks", spark.createDataFrame([("a", "x", [1.0], 0), ("b", "y", [1.0], 1)], kind)) == 2
    store.index("chunks", spark.createDataFrame([("a", "z", [2.0], 0)], kind))
    assert {(r["chunk_id"], r["document_name"]) for r in store.all_chunks("chunks").collect()} == {("a", "z"), ("b", "y")}
    assert store.read("chunks", {"document_name": "y"}).count() == 1
    assert store.collections() == ["chunks"]
    with pytest.raises(ValueError):
        store.index("chunks", spark.createDataFrame([("c", "z", None, 0)], kind))
    with pytest.raises(FileNotFoundError):
        store.read("none")


def test_cache(spark):
    cache = spark.createDataFrame([(cache_key("m", "p"), "r")], "key string, response string")
    got = with_cache(spark.createDataFrame([("m", "p"), ("m", "q")], "model string, prompt string"), cache).orderBy("prompt").collect()
    assert [(r["response"], r["hit"]) for r in got] == [("r", True), (None, False)]


def test_streamed_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"chunk_id": "a", "document_name": "d", "page_number": 1, "raw_text": "t" * 60, "embedding": [1.0]}
    (tmp_path / "in/1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"chunk_id": "b"}))
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    upsert_stream(spark, str(tmp_path / "in"), store, "c", str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/2.json").write_text(json.dumps(row | {"document_name": "e"}))
    upsert_stream(spark, str(tmp_path / "in"), store, "c", str(tmp_path / "cp")).awaitTermination()
    assert {(r["chunk_id"], r["document_name"]) for r in store.all_chunks("c").collect()} == {("a", "e"), ("b", "d")}


def test_catalog_and_chunk_files(spark, tmp_path):
    from mapwright.plans.registry import CATALOG

    (tmp_path / "c.json").write_text(CATALOG)
    got = S.read_catalogs(spark, str(tmp_path)).collect()
    assert [r["control_id"] for r in got] == ["AC-1", "ac-1.1", "UNKNOWN", "ac-2", "au-2"]
    assert {r["requirement_family"] for r in got[:4]} == {"Access Control"}
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(ValueError):
        S.read_catalogs(spark, str(tmp_path))
    (tmp_path / "chunks.jsonl").write_text('{"chunk_id": "a", "document_name": "d", "page_number": 1, "raw_text": "' + "x" * 50 + '"}\nnot json\n{"chunk_id": "b", "page_number": 0, "raw_text": "' + "x" * 50 + '"}\n')
    assert [r["problem"] for r in S.read_chunks(spark, str(tmp_path / "chunks.jsonl"), strict=False).collect()] == [None, "not JSON", "page under 1"]
    with pytest.raises(Exception):
        S.read_chunks(spark, str(tmp_path / "chunks.jsonl")).collect()
    (tmp_path / "g").write_text('{"queries": []}')
    with pytest.raises(ValueError):
        S.read_golden(spark, str(tmp_path / "g"))


def test_block_extraction_by_a_plug_in(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"two|one")
    got = S.read_blocks(spark, str(tmp_path / "a.bin"), lambda raw: [(1, 0.0, 20.0 - i * 10, 1.0, 30.0, t) for i, t in enumerate(raw.decode().split("|"))] + [(1, 0.0, 0.0, 1.0, 1.0, "  ")]).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["one", "two"]


def test_reports(spark, tmp_path):
    chunk = [("k", "doc", 1, None, "text | of\nchunk")]
    rows = [("C1", "F", "T", "D", chunk, ("MappingRationale", True, "fully_compliant", 0.9, "why", None, None)), ("C2", "F", "T", "D", [], ("InsufficientEvidence", None, None, None, None, "r", "c")), ("C3", "F", "T", "D", [], None)]
    frame = spark.createDataFrame(rows, f"control_id string, framework string, title string, description string, chunks {X.CHUNKS}, rationale {X.VERDICT}").coalesce(1)
    csv = X.emit(frame, "csv")[0].splitlines()
    assert len(csv) == 3 and csv[1].startswith('C1,F,T,k,"text | of')
    paths = [str(tmp_path / n) for n in ("a.md", "a.json", "a.html", "a.txt")]
    X.emit(frame, "markdown,oscal,html,other", ",".join(paths))
    text = (tmp_path / "a.md").read_text()
    assert "✅ Compliant (0.90)" in text and "| 1 | doc | 1 | — | text | of chunk |" in text and "N/A" in text
    report = json.loads((tmp_path / "a.json").read_text())["assessment-results"]
    assert [f["target"]["status"]["state"] for f in report["results"]] == ["satisfied", "not-satisfied", "not-satisfied"]
    assert report["observations"][0]["uuid"] == report["results"][0]["related-observations"][0]["observation-uuid"]
    assert len(json.loads((tmp_path / "a.txt").read_text())) == 3
    with pytest.raises(ValueError):
        X.emit(frame, "csv,json")


def test_metrics(spark):
    frame = spark.createDataFrame([(["a"], ["a", "b"]), (["a"], []), ([], ["a"])], "expected array<string>, retrieved array<string>")
    assert E.evaluate_retrieval(frame, "recall").first()["score"] == pytest.approx(1 / 3)
    assert E.evaluate_retrieval(frame, "odd").first()["score"] == pytest.approx(1 / 6)
    none = E.binary_metrics(spark.createDataFrame([], "p int, y int"), "p", "y").first()
    assert none["f1"] == 0 and none["accuracy"] == 0


def test_judges(spark):
    frame = spark.createDataFrame([("p",), ("q",)], "prompt string")
    cache = spark.createDataFrame([(cache_key("m", "p"), "cached")], "key string, response string")
    out, news = J.ask_cached(frame, "prompt", J.ReplayJudge({"q": "fresh"}), "m", cache)
    assert {(r["prompt"], r["answer"]) for r in out.collect()} == {("p", "cached"), ("q", "fresh")}
    assert [r["response"] for r in news.collect()] == ["fresh"]


VERDICT = {"type": "MappingRationale", "is_compliant": True, "compliance_level": "fully_compliant", "confidence_score": 0.9, "explanation": "held"}


def scripted():
    class Scripted:
        """Answers by the first word of the prompt's control, telling the kinds of prompt apart; counts what it is asked."""

        def answer(self, prompts):
            return [self.one(p) for p in prompts]

        def one(self, p):
            control = p.split("## Control\n")[-1]
            if "### Control" in p:
                n = p.count("### Control")
                return "Flags: " + json.dumps([{"control_index": i, "is_meta": "policy upkeep" in p.split(f"### Control {i}\n")[1].split("### Control")[0]} for i in range(n)])
            if "No policy text" in p:
                return json.dumps(VERDICT | {"is_compliant": False, "compliance_level": "non_compliant", "explanation": "gap"}) if "9.1" in control else "no idea"
            if "Judge each" in p:
                if "1.2:" in control:
                    return "I can't answer in an array"
                if "2.2:" in control:
                    subs = [[{"requirement": r, "covered": r == own} for r in "ab"] for own in "ab"]
                    return json.dumps([VERDICT | {"confidence_score": 0.9 - i / 10, "sub_requirements": x} for i, x in enumerate(subs)])
                return json.dumps([VERDICT | {"sub_requirements": [{"requirement": "a", "covered": True}, {"requirement": "b", "covered": "1.3:" in control}]}, {"type": "InsufficientEvidence", "reason": "r", "required_context": "c"}])
            if "Decide first" in p:
                return json.dumps(VERDICT | {"confidence_score": 0.6}) if "good" in p else "nonsense"
            return '{"relevant": false}' if "far" in p else "?"

    return Scripted()


def controls_frame(spark):
    long = "a text of policy that is good and long enough to count"
    chunk = lambda i, t=long, d="doc": (f"c{i}", d, 1, "Sec", t)
    rows = [
        ("1.1", "Roles and responsibilities for performing activities in Requirement 1 are assigned.", [chunk(0)], 0),
        ("1.2", "Do it.", [chunk(1), chunk(2, "another text, of thirty characters and more"), chunk(1)], 1),
        ("1.3", "Do that.", [chunk(3), chunk(4, long + "!", "other"), chunk(5, "short")], 2),
        ("2.1", "policy upkeep", [chunk(6), chunk(7, long + "?", "x")], 3),
        ("2.2", "Do this.", [chunk(8), chunk(9, long + "?", "x")], 4),
        ("9.1", "Nothing there.", [], 5),
        ("9.2", "Nothing there.", [], 6),
    ]
    return spark.createDataFrame([(c, "F", "T", d, k, p) for c, d, k, p in rows], f"control_id string, framework string, title string, description string, chunks {X.CHUNKS}, pos int")


def test_enrichment_path(spark, tmp_path):
    from mapwright.operators.store import AnswerCache

    cache = AnswerCache(spark, f"file://{tmp_path}/cache")
    got = {r["control_id"]: r for r in J.enrich(controls_frame(spark), scripted(), cache=cache).collect()}
    verdict = lambda c: (got[c]["rationale"]["compliance_level"], got[c]["rationale"]["confidence_score"]) if got[c]["rationale"] else None
    assert verdict("1.2") == ("partially_compliant", 0.6) and [c["chunk_id"] for c in got["1.2"]["chunks"]] == ["c1"]  # asked one by one
    assert verdict("1.3") == ("fully_compliant", 0.9) and [c["chunk_id"] for c in got["1.3"]["chunks"]] == ["c3"]
    assert verdict("2.2") == ("fully_compliant", 0.9) and got["2.2"]["rationale"]["explanation"] == "Combined evidence from 2 chunks covers all 2 sub-requirements: a; b"
    assert got["1.1"]["is_meta"] and verdict("1.1") == ("partially_compliant", 0.75) and got["1.1"]["chunks"] == []
    assert got["2.1"]["is_meta"] and got["2.1"]["rationale"]["explanation"].startswith("Inferred from sibling controls: all 1 evaluated controls in Requirement 2 are compliant")
    assert verdict("9.1") == ("non_compliant", 0.9) and got["9.1"]["rationale"]["explanation"] == "gap" and verdict("9.2") is None
    first = cache.stats()
    assert first["hits"] == 0 and first["misses"] == first["entries"] > 5
    again = {r["control_id"]: r["rationale"] for r in J.enrich(controls_frame(spark), J.ReplayJudge({}), cache=cache).collect()}
    assert again == {c: r["rationale"] for c, r in got.items()} and cache.stats()["hits"] == first["misses"]
    cache.clear()
    assert cache.read().count() == 0


def test_single_questions(spark):
    from mapwright.operators.prompts import load_prompt
    from mapwright.scratch import Scratch

    desk = J.Desk(scripted(), Scratch(spark, "test"))
    frame = spark.createDataFrame([("near", "x"), ("far", "x")], "chunk_text string, control_text string").withColumn("requirement_family", F.lit(""))
    assert {r["chunk_text"]: r["relevant"] for r in J.check_relevance(frame, desk).collect()} == {"near": True, "far": False}
    told = J.Desk(J.ReplayJudge({}), Scratch(spark, "test"))
    assert [r["is_meta"] for r in J.classify_controls(frame.limit(1), told).collect()] == [False]
    raw = spark.createDataFrame([('{"is_meta": true}',), ('say {"is_meta": "yes"}',), ('{"is_meta": 0}',), ("{}",), ("none",), (None,)], "raw string")
    assert [r["v"] for r in raw.select(T.truth(F.col("raw"), "is_meta", True).alias("v")).collect()] == [True, True, False, False, True, True]
    assert "<<control_text>>" in load_prompt("gap_rationale.txt")
    with pytest.raises(FileNotFoundError):
        load_prompt("none")


def test_hundredths_round_as_exact_values(spark):
    import random

    r = random.Random(1)
    values = [0.575, 0.125, 0.375, 0.005, 0.015, 1.0, 0.0, 0.995, 0.29, 1e-9] + [r.randrange(2001) / 2000 for _ in range(500)] + [r.random() for _ in range(200)]
    got = [x["v"] for x in spark.createDataFrame([(v,) for v in values], "x double").select(V.hundredths(F.col("x")).alias("v")).collect()]
    assert got == [round(v, 2) for v in values]


def test_command_line_maps_with_rationale(spark, tmp_path, monkeypatch, capsys):
    from mapwright import cli
    from mapwright.plans.registry import CATALOG

    monkeypatch.setattr(cli, "local_session", lambda app: spark)
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat/a.json").write_text(CATALOG)
    (tmp_path / "cat/b.json").write_text(CATALOG.replace("NIST SP 800-53 Rev 5", "PCI"))
    lines = [{"chunk_id": f"k{i}", "document_name": "doc", "page_number": 1, "raw_text": t} for i, t in enumerate(["Audit events: log all events and keep the audit log for a year.", "Accounts are approved, reviewed and removed by the owner of the system.", "The policy is written down and reviewed every year by the board."])]
    (tmp_path / "chunks.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    assert cli.main(["index", str(tmp_path / "chunks.jsonl"), f"file://{tmp_path}/store"]) == 0
    assert cli.main(["map", f"file://{tmp_path}/store", str(tmp_path / "cat"), "--rationale", "--top-k", "2", "--cache", f"file://{tmp_path}/answers", "--format", "json,html", "--out", f"{tmp_path}/r.json,{tmp_path}/r.html"]) == 0
    got = json.loads((tmp_path / "r.json").read_text())
    assert [(r["framework"], r["control_id"]) for r in got] == [(f, c) for f in ("NIST-800-53", "PCI-DSS") for c in ("AC-1", "ac-1.1", "UNKNOWN", "ac-2", "au-2")]
    assert all("rationale" in r for r in got)
    page = (tmp_path / "r.html").read_text()
    assert page.count("<details data-verdict") == 10 and "of 3 chunks mapped" in page
    capsys.readouterr()
    assert cli.main(["harmonize", str(tmp_path / "cat"), "--threshold", "0.99"]) == 0
    common = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [c["theme"] for c in common] == ["Policy", "Deeper", "Deepest", "Accounts", "Events"] and common[0]["source_references"] == ["AC-1", "AC-1"]
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"query": "audit events", "expected_ids": ["k0"]}]}))
    assert cli.main(["eval", f"file://{tmp_path}/store", str(tmp_path / "g.json"), "--metric", "handoff", "--top-k", "1"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["contexts"] == [lines[0]["raw_text"]]


def test_store_keeps_the_last_of_a_call(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    kind = "chunk_id string, document_name string, embedding array<float>"
    for n in range(4):
        assert store.index("c", spark.createDataFrame([("a", f"first{n}", [1.0]), ("b", "x", [1.0]), ("a", f"last{n}", [1.0])], kind).coalesce(1)) == 3
    rows = store.all_chunks("c").collect()
    assert [(r["chunk_id"], r["document_name"]) for r in rows] == [("b", "x"), ("a", "last3")] and "extraction_order" in rows[0]
    assert len([*(tmp_path / "store/c").iterdir()]) == 2


def test_report_parts(spark, tmp_path):
    frame = controls_frame(spark).drop("pos").withColumn("rationale", F.lit(None).cast(X.VERDICT))
    for kind in ("csv", "markdown", "oscal", "html", "json"):
        X.export_parts(frame, kind, f"file://{tmp_path}/{kind}")
        assert any(p.name.startswith("part-") for p in (tmp_path / kind).iterdir())
