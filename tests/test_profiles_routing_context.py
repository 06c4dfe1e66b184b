import json

import pytest
from pyspark.sql import functions as F

from timeloom.functions.schemas import PROFILE_KEYS
from timeloom.operators import profiles as P
from timeloom.operators import routing as R
from timeloom.plans import context as X
from timeloom.sources import corpus as S


def record(**extra):
    k = PROFILE_KEYS
    base = {"skill_id": "s", "record_type": "stage", "stage_id": "T1", "stage_name": "name", k["beliefs"]: ["a", "", "b"], k["relationships"]: {"Ann": "friend", "Bob": "foe"}, k["card"]: {"card_id": "c", "content": "card text", "metadata": {"character": "Big Cy", "timeline_stage": "T1"}}}
    return base | extra


@pytest.fixture
def profile_dir(tmp_path):
    lines = [{"skill_id": "s", "record_type": "meta", "character": "Cy"}, record(), record(stage_id="T2", character="Cy")]
    (tmp_path / "a_temporal_persona_skill.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines[:2]) + "\n\n  \n" + json.dumps(lines[2], ensure_ascii=False) + "\n")
    (tmp_path / "other.jsonl").write_text("ignored")
    return tmp_path


def test_profiles_from_files_to_chunks(spark, profile_dir):
    good, bad = S.read_profiles(spark, str(profile_dir))
    assert good.count() == 3 and bad.count() == 0
    chunks = {r.chunk_id: r for r in P.profile_chunks(P.stage_rows(good)).collect()}
    assert len(chunks) == 10
    r = chunks["persona_Big_Cy_T1_relationships"]
    assert r.text == "角色：Big Cy\n阶段：T1 name\n与其他角色的关系状态：\n- Ann：friend\n- Bob：foe" and r.stage_order is None
    assert "核心信念：a；b\n" in chunks["persona_Big_Cy_T1_persona_core"].text
    text = P.profile_text(P.stage_rows(good)).where("stage_id = 'T1'").first().text
    assert text.startswith("角色：Big Cy\n阶段：T1 name\n阶段顺序：\n") and "核心信念：a；；b\n" in text and "Ann：friend；Bob：foe" in text
    S.write_profiles(good, f"{profile_dir}/out")
    again, _ = S.read_profiles(spark, f"{profile_dir}/out", "*.json")
    assert sorted(map(str, again.drop("file").collect())) == sorted(map(str, good.drop("file").collect()))


def test_malformed_rows_are_errors_or_set_aside(spark, profile_dir):
    (profile_dir / "b_temporal_persona_skill.jsonl").write_text("{broken\n")
    with pytest.raises(S.BadRows, match="b_temporal"):
        S.read_profiles(spark, str(profile_dir))
    good, bad = S.read_profiles(spark, str(profile_dir), strict=False)
    assert good.count() == 3 and [r.row for r in bad.collect()] == ["{broken"]


def test_enrich_twice_and_inventory(spark, profile_dir):
    good, _ = S.read_profiles(spark, str(profile_dir))
    new = spark.createDataFrame([("T1", ("anchor", ["e"], [], [], "boost"))], "stage_id string, enrichment struct<stage_anchor:string,event_distillation:array<string>,persona_texture:array<string>,dialogue_mimic:array<string>,content_boost:string>")
    once, n = P.enrich(good, new)
    twice, _ = P.enrich(once, new)
    assert n.first().enriched == 1
    assert {r.stage_id: r.card.content for r in twice.where("record_type = 'stage'").collect()} == {"T1": "card text boost", "T2": "card text"}
    declared = spark.createDataFrame([("Cy", ["T2", "T3"])], "character string, active_stages array<string>")
    assert sorted((str(r.character), r.stage_id, r.gap) for r in P.inventory_gaps(declared, good).collect()) == [("Cy", "T3", "no row"), ("None", "T1", "not declared")]


def test_last_profile_of_a_stage_counts(spark):
    p = spark.createDataFrame([("a", "T1", "old", 1), ("a", "T1", "new", 2)], "entity string, stage string, v string, row_number int")
    q = spark.createDataFrame([(1, "a", "T1"), (2, "a", "T9")], "query_id int, entity string, stage string")
    good, bad = P.profile_for(q, p)
    assert [(r.query_id, r.v) for r in good.collect()] == [(1, "new")] and [r.query_id for r in bad.collect()] == [2]


def parsed(spark, raw):
    return R.parse_replies(spark.createDataFrame([(raw, "asked")], "raw string, query string")).first()


def test_replies_in_all_forms(spark):
    body = '{"intent": "relationship", "persona_k": 3, "confidence": 2}'
    for raw in (body, f"```json\n{body}\n```", f"Well: {body} so.", f"  {body}\n"):
        r = parsed(spark, raw)
        assert (r.parsed, r.intent, r.persona_k, r.novel_k, r.confidence, r.rewritten_query) == (True, "relationship", 3, 5, 1.0, "asked")
    for raw in ("nothing", "{broken", "[1, 2]", "", None, "} {"):
        r = parsed(spark, raw)
        assert (r.parsed, r.intent, r.persona_k, r.confidence) == (False, "stage_event", 5, 0.5)


@pytest.mark.parametrize(("value", "flag"), [("true", True), ('"false"', True), ('""', False), ("0", False), ("2", True), ("null", False), ("[]", False), ("[1]", True), ("{}", False)])
def test_flags(spark, value, flag):
    assert parsed(spark, f'{{"future_risk": {value}}}').future_risk is flag


@pytest.mark.parametrize(("value", "k"), [('"3"', 3), ("3.7", 3), ('"3.5"', 5), ("99", 8), ("-2", 0), ('"x"', 5), ("null", 5), ("true", 1)])
def test_whole_numbers(spark, value, k):
    assert parsed(spark, f'{{"persona_k": {value}}}').persona_k == k


@pytest.mark.parametrize(("value", "c"), [('"0.25"', 0.25), ('"NaN"', 0.0), ("-1", 0.0), ('"text"', 0.5), ("null", 0.5)])
def test_confidence(spark, value, c):
    assert parsed(spark, f'{{"confidence": {value}}}').confidence == c


def test_words_for_nothing_and_unknown_names(spark):
    r = parsed(spark, '{"relationship_target": " None ", "intent": "odd", "retrieval_policy": "odd", "rewritten_query": "new"}')
    assert (r.relationship_target, r.intent, r.retrieval_policy, r.rewritten_query) == (None, "stage_event", "balanced", "new")
    assert parsed(spark, '{"relationship_target": " Ann "}').relationship_target == "Ann"


def test_modes_and_turn_rules(spark):
    names = [" Realistic ", "1", "透", None, "通透", "0"]
    good, bad = R.normalise_modes(spark.createDataFrame([(n,) for n in names], "mode string"))
    assert sorted(r.mode for r in good.collect()) == ["temporal", "temporal", "transparent", "transparent"] and bad.count() == 2
    rows = [("T1", "temporal", "n", " hi "), ("T9", "temporal", "n", "x"), ("T1", "odd", "n", "x"), ("T1", "temporal", "n" * 129, "x"), ("T1", "temporal", None, ""), ("T1", "temporal", "n", "x" * 4001), ("T1", "temporal", "n" * 128, "x" * 4000), (None, "temporal", "n", None)]
    good, bad = R.validate_turns(spark.createDataFrame(rows, "stage string, mode string, thread_name string, message string"), ["T1"])
    assert sorted(len(r.message) for r in good.collect()) == [2, 4000]
    assert sorted(r.reject_reason for r in bad.collect()) == ["empty message", "long message", "mode", "stage", "stage", "thread_name"]


def test_search_text_and_digests(spark):
    q = spark.createDataFrame([(1, "Ann", "T1", "", list("abcdefgh"), "why?"), (2, "Ann", "T1", "dawn", [], "why?")], "query_id int, entity string, stage string, stage_name string, known_events array<string>, query string")
    a, b = (r.search_text for r in R.build_queries(q, "goal").orderBy("query_id").collect())
    assert a == "角色：Ann\n时间线阶段：T1\n当前阶段已知事件：a；b；c；d；e；f\n用户问题：why?\ngoal" and b == "角色：Ann\n时间线阶段：T1\n阶段名称：dawn\n用户问题：why?\ngoal"


def test_relations_by_target_alias_and_query(spark):
    q = spark.createDataFrame([(1, "Cy", "T1", "what of Annie", None), (2, "Cy", "T1", "hm", "old Bob"), (3, "Cy", "T1", "hm", "Annie"), (4, "Cy", "T1", "hm", ""), (5, "Cy", "T1", "Bob and Ann", None)], "query_id int, entity string, stage string, query string, target string")
    p = spark.createDataFrame([("Cy", "T1", {"Ann": "friend", "Bob": "foe"})], "entity string, stage string, relationships map<string,string>")
    aliases = spark.createDataFrame([("Ann", "Ann"), ("Ann", "Annie")], "name string, alias string")
    got = {r.query_id: r.relations for r in X.relation_context(X.relations_asked(q, p, aliases)).collect()}
    ann = "[stage_profile_Cy_T1_relationship_Ann] Cy在T1阶段对Ann的关系态度：friend"
    assert set(got) == {1, 2, 3, 5} and got[1] == got[3] == ann and got[5].split("\n")[0] == ann and got[2].endswith("foe")


def test_context_blocks_gates_and_history(spark):
    lines = spark.createDataFrame([(1, "profile", 2, "p2"), (1, "profile", 1, "p1"), (1, "memory", 1, "m"), (2, "relations", 1, "r")], "query_id int, block string, position int, line string")
    got = X.assemble(lines, {b: b for b in X.BLOCKS}).collect()
    assert [(r.query_id, r.context) for r in got] == [(1, "memory\nm\n\nrelations\n无\n\nprofile\np1\n\np2\n\ncorpus\n无\n\nexternal\n无")]
    asks = spark.createDataFrame([(1, "transparent", True, "q"), (2, "temporal", True, "q"), (3, "transparent", False, "q"), (4, "transparent", True, " ")], "query_id int, mode string, web_search_needed boolean, web_search_query string")
    results = spark.createDataFrame([(i, "t", None, None, p) for i in range(1, 5) for p in range(7)], "query_id int, title string, url string, content string, position int")
    items = X.external_items(asks, results).collect()
    assert len(items) == 5 and all((r.query_id, r.item_id, r.content) == (1, "web_search:t", "") for r in items)
    m = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", ""), (1, 3, "user", "now"), (2, 1, "user", "x"), (2, 2, "assistant", "now"), (2, 3, "system", "s")], "thread_id int, message_id int, role string, content string")
    now = spark.createDataFrame([(1, "now"), (2, "now")], "thread_id int, message string")
    assert sorted((r.thread_id, r.message_id) for r in X.history(m, now).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_chunk_files_and_embedding_exchange(spark, tmp_path):
    c = spark.createDataFrame([("a", "one\r\ntwo", "x", 1), ("b", "three", "y", None)], "chunk_id string, text string, kind string, n int")
    counts = S.write_chunks(c, f"{tmp_path}/chunks", ["kind", "n"], "kind")
    assert {r.collection: r.chunks for r in counts.collect()} == {"x": 1, "y": 1}
    (tmp_path / "more.jsonl").write_text('{"chunk_id": "z", "text": 5, "metadata": {}}\n{"chunk_id": "q", "text": "ok", "metadata": {"k": "v"}}\n{"text": "t", "metadata": []}\n')
    good, bad = S.read_chunks(spark, f"{tmp_path}/more.jsonl", strict=False)
    assert [(r.chunk_id, r.metadata) for r in good.collect()] == [("q", {"k": "v"})] and bad.count() == 2
    with pytest.raises(S.BadRows):
        S.read_chunks(spark, f"{tmp_path}/more.jsonl")
    lines = S.embedding_lines(c)
    assert [(r.line_index, r.chunk_id, r.line) for r in lines.orderBy("line_index").collect()] == [(0, "a", "one  two"), (1, "b", "three")]
    assert S.write_embedding_lines(lines, f"{tmp_path}/lines") == 2
    raw = ['{"embedding": [1, 2]}', '{"output": {"embedding": [3.5]}}', '{"embeddings": [{"embedding": [4]}]}', '{"embeddings": [[5, 6]]}', '{"other": 1}', "no json"]
    got, rest = S.read_vectors(spark.createDataFrame(list(enumerate(raw)), "line_index long, raw string"))
    assert [r.embedding for r in got.orderBy("line_index").collect()] == [[1.0, 2.0], [3.5], [4.0], [5.0, 6.0]] and rest.count() == 2
    assert S.attach_vectors(lines, got.where("line_index < 2")).count() == 2
    with pytest.raises(S.BadRows):
        S.attach_vectors(lines, got.where("line_index < 3"))
    meta = S.clean_metadata(c.withColumn("l", F.array("kind")), ["kind", "n", "l"]).orderBy("chunk_id").collect()
    assert (meta[1].n, meta[0].n, meta[0].l) == ("", "1", '["x"]')


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line\nline")
    r = S.read_texts(spark, str(tmp_path / "a.txt"), source="book", work="w").first()
    assert (r.text, r.source, r.work) == ("line\nline", "book", "w") and r.file.endswith("a.txt")
