"""SQL that gives the same rows as the registered queries, for a single-node engine over the same tables."""

from __future__ import annotations

from .queries import ALIASES, BLOCKS, GOAL, HEADINGS, MARKERS, NAMES, RULES
from .standins import NOW

_TOKEN = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


CHUNKS = """chunks as (select 'doc_' || lpad(cast(doc_id as varchar), cast(greatest(6, length(cast(doc_id as varchar))) as integer), '0') chunk_id, doc_id, text, source entity, label % 7 stage_order,
    'T' || (label % 7) stage, list_transform(cast(embedding as double[]), lambda x, i: x + (doc_id * 31 + i * 17) % 101 / 5000::double) embedding from documents left join embeddings on doc_id % (select count(*) from embeddings) = vec_id)"""

QUESTIONS = """questions as (select item_id query_id, text, cast(item_id % 7 as integer) stage_order, 'T' || (item_id % 7) stage, 'src' || (item_id % 20) entity,
    cast(embedding as double[]) embedding from benchmark join embeddings on item_id = vec_id)"""

MEMORIES = """memories as (select event_id id, 'mem_' || event_id memory_id, user_id, event_type entity, 'T' || (user_id % 7) stage, 'temporal' as mode, 'thread1' thread_name,
    round(least(1.0, value / 100), 4) importance, case when event_id % 5 <> 0 then cast(json_extract_string(props, '$.k') as integer) / 100.0::double end original_importance,
    'summary ' || event_id summary, 'content ' || event_id content, '{}' metadata, cast(ts as timestamp) created_at, cast(ts as timestamp) updated_at,
    case when event_id % 3 = 0 then cast(ts as timestamp) + interval 1 day end last_used_at from events)"""

THREADS = """threads as (select distinct conv_id thread_id, conv_id % 10 user_id, 'src' || (conv_id % 4) entity, 'T' || (conv_id % 7) stage,
    case when conv_id % 2 = 0 then 'temporal' else 'transparent' end as mode, 'thread' || conv_id thread_name, 1704067200 + conv_id * 60 updated_s from conversations)"""

MESSAGES = """messages as (select conv_id * 1000 + turn message_id, conv_id thread_id, 'key' || conv_id session_key, role, text content,
    1704067200 + conv_id * 60 + turn * 3600 + (turn // 4) * 86400 at_s from conversations)"""

PROFILES = """ev as (select c_nationkey, list(c_name order by c_custkey) events from customer group by 1),
    seg as (select c_nationkey, c_mktsegment m, count(*)::varchar n from customer group by 1, 2),
    rel as (select c_nationkey, list(m order by m) names, list(n order by m) counts from seg group by 1),
    profiles as (select n_nationkey k, n_name name, 'T' || n_regionkey stage, n_regionkey, coalesce(events, []) events, names, counts
        from nation left join ev on n_nationkey = ev.c_nationkey left join rel on n_nationkey = rel.c_nationkey)"""

_DIST = "list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _near(condition: str, k: int) -> str:
    return f"""near as (select query_id, chunk_id, distance, row_number() over (partition by query_id order by distance, chunk_id) dense_rank
        from (select query_id, chunk_id, {_DIST} distance from questions q join chunks c on {condition})
        qualify dense_rank <= {k})"""


_ALL, _SO_FAR, _SCOPE = "true", "c.stage_order <= q.stage_order", "c.entity = q.entity and c.stage = q.stage"


def _topk(condition: str) -> str:
    return f"with {CHUNKS}, {QUESTIONS}, {_near(condition, 5)} select query_id, chunk_id, round(distance, 6) distance, round(1 / (1 + distance), 6) dense_score, cast(dense_rank as integer) dense_rank from near"


def _bm25(pool: str, corpus: bool = False) -> str:
    toks = f"list_transform(regexp_extract_all(text, '{_TOKEN}'), lambda x: lower(x))"
    stats = (
        f"stats as (select count(*) docs, avg(len({toks})) mean from chunks), df as (select term, count(*) df from (select distinct chunk_id, unnest({toks}) term from chunks) group by 1)"
        if corpus
        else "stats as (select query_id, count(*) docs, avg(len) mean from sized group by 1), df as (select query_id, term, count(*) df from (select distinct query_id, chunk_id, term from tf) group by 1, 2)"
    )
    join = "cross join stats join df using (term)" if corpus else "join stats using (query_id) join df using (query_id, term)"
    return f"""sized as (select p.query_id, p.chunk_id, {toks} toks, len({toks}) len from {pool} p join chunks using (chunk_id)),
        terms as (select query_id, term, count(*) times from (select query_id, unnest({toks}) term from questions) group by 1, 2),
        tf as (select query_id, chunk_id, len, term, count(*) tf from (select query_id, chunk_id, len, unnest(toks) term from sized) group by 1, 2, 3, 4),
        {stats},
        bm as (select query_id, chunk_id, sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / case when mean > 0 then mean else 1 end)))) score
            from tf join terms using (query_id, term) {join} group by 1, 2 having score <> 0)"""


def _hybrid(condition: str, pool_k: int, wd: float, ws: float) -> str:
    return f"""with {CHUNKS}, {QUESTIONS}, {_near(condition, max(30, pool_k))}, pool as (select query_id, chunk_id from near where dense_rank <= {pool_k}), {_bm25("pool")},
        routes as (select query_id, chunk_id, 'dense' route, 1 / (1 + distance) score from near where dense_rank <= 30 union all select query_id, chunk_id, 'bm25', score from bm),
        ext as (select *, min(score) over w low, max(score) over w high from routes window w as (partition by query_id, route)),
        norm as (select query_id, chunk_id, route, score, case when high > low then (score - low) / (high - low) else 0.5 end * case route when 'dense' then {wd} else {ws} end part from ext),
        fused as (select query_id, chunk_id, sum(part) fused, max(score) filter (route = 'dense') dense, max(score) filter (route = 'bm25') bm from norm group by 1, 2)
        select query_id, chunk_id, round(coalesce(dense, 0), 6) dense_score, round(coalesce(bm, 0), 6) bm25_score, round(fused, 6) fused_score, 0.0::double rerank_score,
            cast(row_number() over (partition by query_id order by fused desc, chunk_id) as integer) rank from fused qualify rank <= 5"""


_ROUTES = """per as (select c_mktsegment query_id, o_custkey chunk_id, round(sum(o_totalprice), 2) total, count(*)::double n from orders join customer on o_custkey = c_custkey group by 1, 2),
    routes as (select query_id, chunk_id, 'dense' route, total score from per where chunk_id % 3 <> 0 union all select query_id, chunk_id, 'bm25', n from per where chunk_id % 4 <> 0),
    normed as (select query_id, chunk_id, route, case when max(score) over w > min(score) over w then (score - min(score) over w) / (max(score) over w - min(score) over w) else 0.5 end norm
        from routes window w as (partition by query_id, route))"""

_LINES = r"""case when text is null or text = '' then [] else string_split(regexp_replace(regexp_replace(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n$', ''), chr(10)) end"""

_CHUNK_FIXED = f"""select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as integer) piece, cast(length(chunk) as integer) n_chars, md5(chunk) chunk_md5 from (
    select doc_id, i, {_strip("substr(text, cast(i * 1620 + 1 as bigint), 1800)")} chunk from (select doc_id, text, unnest(range(0, cast(greatest(0, ceil((length(text) - 1800) / 1620.0)) as bigint) + 1)) i from documents where length(text) > 0)) where chunk <> ''"""

_SO_FAR_W = "(partition by doc_id order by line_no rows between unbounded preceding and current row)"
_KIND = "case " + " ".join(f"when regexp_matches(line, '^(?:{p})') then '{k}'" for k, p in HEADINGS.items()) + " end"

_STAGE = "case " + " ".join(f"when regexp_matches(substr(coalesce(text, ''), 1, 1200), {_q(r['text'])}) then {_q(s)}" for r, s in RULES) + " else 'T0' end"

_FOUND = "list_filter([" + ", ".join(_q(n) for n in NAMES) + "], lambda n: contains(text, n))"
_ADDED = "list_filter([" + ", ".join(f"case when contains(text, {_q(a)}) then {_q(n)} end" for a, n in ALIASES.items()) + "], lambda n: n is not null)"
_MENTIONS = f"(select text, doc_id, {_FOUND} || list_filter(list_distinct({_ADDED}), lambda n: not list_contains({_FOUND}, n)) names from documents)"


def _profile_lines(kind: str) -> str:
    head = "'角色：' || name || chr(10) || '阶段：' || stage || ' stage of ' || name || chr(10) || "
    rel = "array_to_string(list_transform(range(1, len(names) + 1), lambda i: '- ' || names[i] || '：' || counts[i]), chr(10))"
    body = {
        "persona_core": "'阶段定位：position ' || name || chr(10) || '当前人格状态：state ' || name || chr(10) || '核心信念：one；' || name || chr(10) || '情绪底色：calm' || chr(10) || '语言风格：plain'",
        "knowledge_boundary": "'已知事件：' || array_to_string(events, '；') || chr(10) || '禁止知道的未来事件：later' || chr(10) || '典型回答倾向：a；b' || chr(10) || '容易发生的人设漂移：' || chr(10) || '人设一致性校验规则：rule'",
        "relationships": f"'与其他角色的关系状态：' || chr(10) || coalesce({rel}, '')",
        "novel_enrichment": "'小说阶段锚点：anchor ' || name || chr(10) || '小说事件蒸馏：e1；e2' || chr(10) || '人格纹理：' || chr(10) || '语气模拟：m' || chr(10) || '小说融合补强：boost ' || name",
        "rag_card": "'RAG知识卡片：card of ' || name",
    }[kind]
    return f"""select 'persona_' || replace(name, ' ', '_') || '_' || stage || '_{kind}' chunk_id, '{kind}' chunk_kind, {_strip(f"({head}{body})")} as text, name character, stage timeline_stage,
        cast(n_regionkey as integer) stage_order, 'card_' || k card_id, 'nation.jsonl' source from profiles"""


_SECTIONS = f"""
    lines as (select doc_id, unnest(range(0, len(ls))) line_no, unnest(list_transform(ls, lambda x: {_strip("x")})) line from (select doc_id, {_LINES} ls from documents)),
    kinds as (select *, {_KIND} kind from lines),
    run as (select *, count(kind) over {_SO_FAR_W} section, max(case when kind = 'book' then line_no end) over {_SO_FAR_W} book_at,
        max(case when kind in ('book', 'part', 'prologue') then line_no end) over {_SO_FAR_W} part_at from kinds),
    marked as (select r.*, b.line book, case when p.kind = 'part' then p.line end part from run r
        left join kinds b on r.doc_id = b.doc_id and r.book_at = b.line_no left join kinds p on r.doc_id = p.doc_id and r.part_at = p.line_no),
    whole as (select doc_id, section, max(book) book, max(part) part, max(case when kind is not null then line end) title,
        {_strip("string_agg(case when kind is null then line end, chr(10) order by line_no)")} body from marked group by 1, 2)"""



def _split(base: str) -> str:
    """Table expressions up to ``split`` (doc_id, part, piece, text): the texts of ``base`` (doc_id, part, text) cut at line ends.

    The prose has none of the other separators, so a line longer than a chunk is cut by windows. ``offs`` are the
    offsets of pieces; ``walk`` reads piece after piece, and ``s`` is the first one that is held.
    """
    return f"""cuts as (select *, list_sort(list_distinct([0::bigint] || list_transform(range(1, len(n)), lambda k: cast(list_sum(n[1:k]) + k - 1 as bigint)) || [length(text)])) offs
            from (select *, list_transform(string_split(text, chr(10)), lambda x: length(x)) n from {base} where length(text) > 0)),
        walk as (select doc_id, part, offs, 0::bigint i, 0::bigint s, null::bigint closed, false long from cuts
            union all select doc_id, part, offs, i + 1,
                case when offs[i + 2] - offs[i + 1] > 1800 then i + 1
                    when s < i and offs[i + 2] - offs[s + 1] > 1800 then list_min(list_filter(range(s, i + 1), lambda j: offs[i + 1] - offs[j + 1] <= 180 and offs[i + 2] - offs[j + 1] <= 1800)) else s end,
                case when s < i and (offs[i + 2] - offs[i + 1] > 1800 or offs[i + 2] - offs[s + 1] > 1800) then s end, offs[i + 2] - offs[i + 1] > 1800
            from walk where i < len(offs) - 1),
        spans as (select doc_id, part, i, 0 w, offs[closed + 1] low, offs[i] high from walk where closed is not null
            union all select doc_id, part, i + 1, 0, offs[s + 1], offs[i + 1] from walk where i = len(offs) - 1 and s < i
            union all select doc_id, part, i, 1 + w, offs[i] + 1620 * w, least(offs[i + 1], offs[i] + 1620 * w + 1800)
                from (select *, unnest(range(0, cast(ceil((offs[i + 1] - offs[i] - 1800) / 1620.0) as bigint) + 1)) w from walk where long)),
        said as (select doc_id, part, i, w, {_strip("substr(text, cast(low + 1 as bigint), cast(high - low as bigint))")} chunk from spans join cuts using (doc_id, part)),
        split as (select doc_id, part, cast(row_number() over (partition by doc_id, part order by i, w) - 1 as integer) piece, chunk as text from said where chunk <> '')"""


SQL: dict[str, str] = {
    "tokenize_counts": f"select doc_id, cast(len(t) as integer) n_tokens, cast(len(list_distinct(t)) as integer) n_terms from (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'), lambda x: lower(x)) t from documents)",
    "dense_topk": _topk(_ALL),
    "visible_topk": _topk(_SO_FAR),
    "scoped_topk": _topk(_SCOPE),
    "bm25_pool": f"with {CHUNKS}, {QUESTIONS}, {_near(_SO_FAR, 20)}, {_bm25('near')} select query_id, chunk_id, round(score, 6) score from bm",
    "bm25_corpus": f"with {CHUNKS}, {QUESTIONS}, {_near(_SO_FAR, 20)}, {_bm25('near', True)} select query_id, chunk_id, round(score, 6) score from bm",
    "minmax_routes": f"with {_ROUTES} select query_id, chunk_id, route, round(norm, 6) norm from normed",
    "fuse_routes": f"with {_ROUTES} select query_id, chunk_id, round(sum(norm * case route when 'dense' then 0.7 else 0.3 end), 6) fused_score from normed group by 1, 2",
    "hybrid_retrieve": _hybrid(_SO_FAR, 20, 0.65, 0.35),
    "hybrid_profiles": _hybrid(_SCOPE, 40, 0.7, 0.3),
    "rerank_topn": f"""with {CHUNKS}, {QUESTIONS}, {_near(_SO_FAR, 30)} select query_id, chunk_id, rel rerank_score, cast(row_number() over (partition by query_id order by rel desc, chunk_id) as integer) rerank_rank
        from (select query_id, chunk_id, ((query_id * 31 + cast(substr(chunk_id, 5) as bigint) * 17) % 1000) / 1000.0::double rel from near) qualify rerank_rank <= 5""",
    "stage_audit": f"with {CHUNKS}, {QUESTIONS}, {_near(_ALL, 5)} select n.query_id, n.chunk_id, c.stage_order, q.stage_order asked from near n join questions q using (query_id) join chunks c using (chunk_id) where c.stage_order > q.stage_order",
    "sections": f"""with {_SECTIONS} select doc_id, cast(row_number() over (partition by doc_id order by section) as integer) section_index, book, part, coalesce(title, 'front_matter') section_title,
        cast(length(body) as integer) n_chars, md5(body) body_md5 from whole where body <> '' and (title is null or length(body) >= 500)""",
    "chunk_fixed": _CHUNK_FIXED,
    "chunk_recursive": f"with recursive base as (select doc_id, 0 part, text from documents), {_split('base')} select doc_id, piece, cast(length(text) as integer) n_chars, md5(text) chunk_md5 from split",
    "corpus_chunks": f"""with recursive {_SECTIONS}, base as (select doc_id, row_number() over (partition by doc_id order by section) part, body as text from whole where body <> '' and (title is null or length(body) >= 500)), {_split("base")},
        stay as (select *, row_number() over (order by doc_id, part, piece) - 1 k from split where not ({" or ".join(f"contains(text, {_q(m)})" for m in MARKERS)})),
        named as (select *, {_STAGE} stage, {_FOUND} || list_filter(list_distinct({_ADDED}), lambda n: not list_contains({_FOUND}, n)) names from stay)
        select 'novel_' || stage || '_' || lpad(k::varchar, cast(greatest(6, length(k::varchar)) as integer), '0') chunk_id, doc_id, cast(part as integer) section_index, piece, stage,
            case when len(names) > 0 then '|' || array_to_string(names, '|') || '|' else '' end character_mentions, md5(text) text_md5 from named""",
    "chunk_ids": f"""with l as (select doc_id, unnest(range(0, len(ls))) piece, unnest(ls) line from (select doc_id, {_LINES} ls from documents)),
        n as (select doc_id, cast(piece as integer) piece, row_number() over (order by doc_id, piece) - 1 i from l where line <> '')
        select doc_id, piece, i chunk_index, 'novel_T' || (doc_id % 7) || '_' || lpad(i::varchar, cast(greatest(6, length(i::varchar)) as integer), '0') chunk_id from n""",
    "stage_infer": f"select doc_id, stage, cast(substr(stage, 2) as integer) stage_order, 'anchor ' || substr(stage, 2) anchor from (select doc_id, {_STAGE} stage from documents)",
    "entity_mentions": f"select doc_id, case when len(names) > 0 then '|' || array_to_string(names, '|') || '|' else '' end character_mentions, cast(len(names) as integer) n from {_MENTIONS}",
    "skip_markers": "select doc_id, source from documents where not (" + " or ".join(f"contains(text, {_q(m)})" for m in MARKERS) + ")",
    "chunk_report": "select 'chunks' collection, count(*) chunks from documents union all select 'profiles', 5 * count(*) from nation",
    "profile_sections": f"with {PROFILES} " + " union all ".join(_profile_lines(k) for k in ("persona_core", "knowledge_boundary", "relationships", "novel_enrichment", "rag_card")),
    "profile_text": f"""with {PROFILES} select 'skill_' || k skill_id, array_to_string(['角色：' || name, '阶段：' || stage || ' stage of ' || name, '阶段顺序：' || n_regionkey, '阶段定位：position ' || name, '当前人格状态：state ' || name,
        '核心信念：one；；' || name, '情绪底色：calm', '语言风格：plain', '已知事件：' || array_to_string(events, '；'), '禁止知道的未来事件：later',
        '与其他角色的关系状态：' || coalesce(array_to_string(list_transform(range(1, len(names) + 1), lambda i: names[i] || '：' || counts[i]), '；'), ''), '典型回答倾向：a；b', '容易发生的人设漂移：', '人设一致性校验规则：rule',
        '小说阶段锚点：anchor ' || name, '小说事件蒸馏：e1；e2', '人格纹理：', '语气模拟：m', '小说融合补强：boost ' || name, 'RAG知识卡片：card of ' || name], chr(10)) as text from profiles""",
    "profile_metadata": """select 'skill_' || n_nationkey skill_id, 'stage' record_type, n_name as character, 'T' || n_regionkey timeline_stage, 'T' || n_regionkey stage_id, 'stage of ' || n_name stage_name, n_regionkey::varchar stage_order,
        'card_' || n_nationkey card_id, 'stage' knowledge_type, 'high' anti_future_sight_level, 'anchor ' || n_name global_timeline_anchor, 'nation' source, 'jsonl' source_format from nation""",
    "enrich_profiles": """select 'skill_' || n_nationkey skill_id, 'T' || n_regionkey stage_id, case when n_regionkey = 4 then 'anchor ' || n_name else 'new T' || n_regionkey end stage_anchor,
        'card of ' || n_name || case when n_regionkey in (1, 4) then '' else ' more T' || n_regionkey end card_text from nation""",
    "inventory_check": "select n_name as character, 'T0' stage_id, 'no row' gap from nation where n_regionkey <> 0 union all select n_name, 'T4', 'not declared' from nation where n_regionkey = 4",
    "profile_lookup": """select s_suppkey query_id, n_name entity, 'T' || case when s_suppkey % 3 = 0 then 0 else n_regionkey end stage,
        case when s_suppkey % 3 <> 0 or n_regionkey = 0 then 'skill_' || n_nationkey end skill_id from supplier join nation on s_nationkey = n_nationkey""",
    "relation_lookup": """with seg as (select c_nationkey, c_mktsegment m, count(*) n from customer group by 1, 2),
        q as (select c_custkey query_id, c_nationkey, n_name e, 'T' || n_regionkey s, case when c_custkey % 2 = 0 then 'about ' || lower(c_mktsegment) else 'about all' end query, case when c_custkey % 3 = 0 then c_mktsegment end target from customer join nation on c_nationkey = n_nationkey)
        select query_id, string_agg('[stage_profile_' || e || '_' || s || '_relationship_' || m || '] ' || e || '在' || s || '阶段对' || m || '的关系态度：' || n, chr(10) order by m) relations
        from q join seg using (c_nationkey) where contains(query, lower(m)) or coalesce(target = m or target = lower(m) or contains(target, m), false) group by 1""",
    "build_query": f"""with {PROFILES} select s_suppkey query_id, array_to_string(list_filter(['角色：' || name, '时间线阶段：' || stage, '阶段名称：stage of ' || name, case when len(events) > 0 then '当前阶段已知事件：' || array_to_string(events[1:6], '；') end,
        '用户问题：' || s_name, '{GOAL}'], lambda x: x is not null), chr(10)) search_text from supplier join profiles on s_nationkey = k""",
    "routing_digests": f"""with {PROFILES} select 'skill_' || k skill_id, coalesce(nullif(array_to_string(events[1:8], '；'), ''), '无') known_digest, 'later' forbidden_digest, coalesce(nullif(array_to_string(names, '、'), ''), '无') relation_names from profiles""",
    "route_parse": """with e as (select event_id i, event_type t, value v, cast(json_extract_string(props, '$.k') as integer) k, event_id % 4 <> 3 ok from events)
        select i query_id, ok parsed, case when ok and i % 3 = 0 then 'relationship' when ok and i % 3 = 1 then 'daily_chat' else 'stage_event' end intent,
            case when ok then round(greatest(0.0, least(1.0, round(v / 100, 4))), 6) else 0.5 end confidence, case when ok and i % 5 <> 0 then t end relationship_target, ok and i % 2 = 0 future_risk,
            'balanced' retrieval_policy, cast(case when ok then greatest(0, least(8, k)) else 5 end as integer) persona_k, 5 novel_k, false web_search_needed, '' web_search_query, 'q' || i rewritten_query, '' answer_guidance from e""",
    "route_defaults": """with e as (select event_id i, cast(json_extract_string(props, '$.k') as integer) k from events),
        r as (select i, case when i % 4 in (0, 2) and i % 2 = 0 then greatest(0, least(8, k)) else 5 end p from e) select i query_id, cast(p as integer) persona_k, 5 novel_k, 'q' || i search_query from r where p > 0""",
    "mode_names": """with m as (select case when l_linenumber % 4 = 0 then 'temporal' when l_linenumber % 4 in (1, 2) then 'transparent' else l_returnflag end as mode, l_linenumber % 4 <> 3 ok from lineitem) select mode, ok, count(*) n from m group by 1, 2""",
    "turn_validation": f"""with c as (select conv_id, turn, case when turn = 2 then '' else '  ' || text end message from conversations),
        r as (select *, case when conv_id % 9 > 6 then 'stage' when conv_id % 5 = 0 then 'mode' when conv_id % 11 = 0 then 'thread_name' when length(coalesce(message, '')) < 1 then 'empty message' when length(message) > 4000 then 'long message' end reject_reason from c)
        select conv_id, turn, reject_reason, cast(case when reject_reason is null then length({_strip("message")}) else length(message) end as integer) n_chars from r""",
    "entity_slugs": "select 'nation-' || (o_orderkey % 30) slug, any_value(n_name) n_name, count(*) n from orders left join nation on o_orderkey % 30 = n_nationkey group by 1",
    "assemble_context": f"""with {CHUNKS}, {QUESTIONS},
        a as ({_near(_SCOPE, 5).split(" as ", 1)[1][1:-1]}), b as ({_near(_SO_FAR, 5).split(" as ", 1)[1][1:-1]}),
        p as (select query_id, string_agg('[' || chunk_id || '] ' || text, chr(10) || chr(10) order by dense_rank) x from a join chunks using (chunk_id) group by 1),
        o as (select query_id, string_agg('[' || chunk_id || '] 阶段=' || stage || ' 章节=' || entity || chr(10) || text, chr(10) || chr(10) order by dense_rank) x from b join chunks using (chunk_id) group by 1),
        w as (select page_id % 50 query_id, page_id, 'page ' || page_id title, case when page_id % 3 = 0 then '' else coalesce(url, '') end url, html content, row_number() over (partition by page_id % 50 order by page_id) r from pages),
        e as (select query_id, string_agg('[web_search:' || case when url = '' then title else url end || '] 标题=' || title || chr(10) || 'URL=' || url || chr(10) || content, chr(10) || chr(10) order by page_id) x from w where r <= 5 and query_id % 2 = 0 and query_id in (select query_id from questions) group by 1),
        t as (select query_id, '{BLOCKS["memory"]}' || chr(10) || '无' || chr(10) || chr(10) || '{BLOCKS["relations"]}' || chr(10) || '无' || chr(10) || chr(10) || '{BLOCKS["profile"]}' || chr(10) || coalesce(p.x, '无') || chr(10) || chr(10) || '{BLOCKS["corpus"]}' || chr(10) || coalesce(o.x, '无') || chr(10) || chr(10) || '{BLOCKS["external"]}' || chr(10) || coalesce(e.x, '无') context
            from questions left join p using (query_id) left join o using (query_id) left join e using (query_id) where p.x is not null or o.x is not null or e.x is not null)
        select query_id, md5(context) context_md5, cast(length(context) as integer) n_chars from t""",
    "threads_upsert": f"""with {THREADS}, new as (select user_id, entity, stage, mode, 'new' || thread_id thread_name, (select max(thread_id) from threads) m from threads where thread_id % 3 = 0)
        select thread_id, user_id, entity, stage, mode, thread_name from threads union all
        select m + row_number() over (order by user_id || chr(31) || entity || chr(31) || stage || chr(31) || mode || chr(31) || thread_name), user_id, entity, stage, mode, thread_name from new""",
    "thread_list": f"with {THREADS} select thread_id, user_id, entity, cast(row_number() over (partition by user_id, entity order by updated_s desc, thread_id desc) as integer) rank from threads",
    "session_keys": f"with {THREADS} select thread_id, 'chat:' || user_id || ':' || entity || ':' || stage || ':' || mode || ':' || case when thread_id % 5 = 0 then '线程1' else thread_name end session_key from threads",
    "append_messages": f"""with {THREADS}, {MESSAGES}, n as (select thread_id, count(*) messages, max(at_s) filter (message_id % 1000 >= 4) latest from messages group by 1)
        select thread_id, coalesce(latest, updated_s) updated_at, messages from threads join n using (thread_id)""",
    "recent_buffer": f"""with {MESSAGES}, g as (select *, sum(case when at_s - prev >= 43200 then 1 else 0 end) over (partition by session_key order by at_s, message_id) run from (select *, lag(at_s) over (partition by session_key order by at_s, message_id) prev from messages)),
        l as (select *, row_number() over (partition by session_key order by at_s desc, message_id desc) back, first_value(run) over (partition by session_key order by at_s desc, message_id desc) last_run, max(at_s) over (partition by session_key) last_at from g)
        select session_key, message_id, role, row_number() over (partition by session_key order by at_s, message_id) - 1 place from l where back <= 3 and run = last_run and (select max(at_s) from messages) - last_at < 43200""",
    "thread_history": f"""with {MESSAGES}, r as (select *, row_number() over (partition by thread_id order by at_s desc, message_id desc) back from messages where thread_id % 3 <> 0)
        select thread_id, message_id, role, row_number() over (partition by thread_id order by at_s, message_id) place from r where back <= 4""",
    "history_clean": f"""with {MESSAGES}, c as (select * from messages where role in ('user', 'assistant') and coalesce(content, '') <> ''),
        cur as (select thread_id, content from messages qualify row_number() over (partition by thread_id order by message_id desc) = 1),
        l as (select c.thread_id, c.message_id from (select * from c qualify row_number() over (partition by thread_id order by message_id desc) = 1) c join cur on c.thread_id = cur.thread_id and c.content = cur.content where c.role = 'user')
        select thread_id, message_id, role from c anti join l using (thread_id, message_id)""",
    "cascade_delete": f"""with {THREADS}, gone as (select thread_id from threads where thread_id > 0 and (thread_id % 4 = 0 or user_id = 3)), n as (select conv_id thread_id, count(*) messages from conversations group by 1)
        select thread_id, user_id, messages from threads join n using (thread_id) where thread_id not in (select thread_id from gone)""",
    "archive_export": f"""with {THREADS}, {MESSAGES}, n as (select thread_id, count(*) message_count, min(at_s) created_at from messages group by 1), p as (select distinct entity, stage from threads where thread_id % 2 = 0)
        select thread_id session_id, t.entity, t.stage, created_at, message_count, case when p.entity is not null then t.entity || '/' || t.stage end profile_id, case when thread_id % 3 = 0 then 'ok' else 'unchecked' end check_status
        from threads t join n using (thread_id) left join p on t.entity = p.entity and t.stage = p.stage""",
    "turn_memories": """with p as (select conv_id, turn, role, text, lead(role) over w nr, lead(text) over w answer from conversations window w as (partition by conv_id order by turn))
        select conv_id, turn, '用户提问：' || substr(text, 1, 160) || ' | X回答：' || substr(answer, 1, 220) summary, md5('用户提问：' || text || chr(10) || 'X回答：' || answer) content_md5, 0.4::double importance from p where role = 'user' and nr = 'assistant'""",
    "memory_ids": f"with {MEMORIES} select id, 'mem_' || user_id || '_' || replace(replace(entity, ' ', '_'), ':', '_') || '_' || stage || '_' || thread_name || '_' || epoch_us(created_at) // 1000 || '_' || substr(sha256(id::varchar), 1, 8) memory_id from memories",
    "memory_list": f"""with {MEMORIES} select id, user_id, entity, round(importance, 6) importance, cast(row_number() over (partition by user_id, entity, stage, mode, thread_name order by importance desc, updated_at desc, id desc) as integer) rank from memories where importance >= 0.15 qualify rank <= 3""",
    "memory_boost": f"""with {MEMORIES} select id, round(case when id % 6 = 0 then least(0.95, importance + 0.1) when id % 3 = 0 then least(0.95, importance + 0.05) else importance end, 6) importance,
        case when id % 3 = 0 then epoch(timestamp '{NOW}')::bigint else coalesce(floor(epoch(last_used_at))::bigint, 0) end last_used_at from memories""",
    "memory_touch": f"with {MEMORIES} select id, case when id % 7 = 0 then epoch(timestamp '{NOW}')::bigint else coalesce(floor(epoch(last_used_at))::bigint, 0) end last_used_at from memories where id % 7 = 0 or id % 11 = 0",
    "memory_upsert": f"""with {MEMORIES}, b as (select *, id % 8 = 0 hit from memories)
        select memory_id, case when hit then 'new' else content end content, round(case when hit then least(1.0, importance * 3) else importance end, 6) importance, round(case when hit then least(1.0, importance * 3) else original_importance end, 6) original_importance,
            case when hit then epoch(timestamp '{NOW}')::bigint else floor(epoch(updated_at))::bigint end updated_at from b
        union all select 'new_' || memory_id, 'new', round(least(1.0, importance * 3), 6), round(least(1.0, importance * 3), 6), epoch(timestamp '{NOW}')::bigint from memories where id % 4 = 0 and id % 8 <> 0""",
    "memory_forget": f"""with {MEMORIES}, r as (select *, 0.60 * importance + 0.25 * greatest(0.0, 1 - date_sub('second', coalesce(last_used_at, created_at), timestamp '{NOW}') / 604800.0::double) + 0.15 * coalesce(round(original_importance, 4), importance) retention,
        count(*) over (partition by user_id, entity, stage, mode, thread_name) - 10 as over_by, importance <= 0.4 can from memories)
        select id, round(retention, 6) retention, can and row_number() over (partition by user_id, entity, stage, mode, thread_name order by can desc, retention, importance, coalesce(last_used_at, created_at), id) <= over_by forgotten from r""",
    "memory_delete": "select event_id id, event_id % 50 thread_id from events where event_id % 50 = 0 or (event_id % 50) % 7 <> 0",
    "memory_index": f"""with {MEMORIES}, t as (select memory_id, importance, content, '记忆类型：episodic' || chr(10) || '角色：' || entity || chr(10) || '时间线阶段：' || stage || chr(10) || '线程：' || thread_name || chr(10) || '摘要：' || summary || chr(10) || '原始内容：' || content x, id from memories)
        select memory_id, md5(case when id % 3 = 0 then x else 'old' end) text_md5, case when id % 3 = 0 then content else 'old' end original, round(importance, 6) importance from t where id % 2 = 0 or id % 3 = 0""",
    "embedding_export": r"select row_number() over (order by doc_id) - 1 line_index, doc_id chunk_id, md5(regexp_replace(text, '[\r\n]', ' ', 'g')) line_md5 from documents",
    "embedding_import": "select 'c' || vec_id chunk_id, cast(len(embedding) as integer) as dim, round(list_sum(cast(embedding as double[])), 5) total from embeddings",
    "embed_documents": "select doc_id, " + ", ".join(f"cast(floor((length(text) - length(replace(text, '{c}', ''))) / greatest(1, length(text))::double * 10000) as bigint) {c}" for c in "aeio") + " from documents",
    "index_upsert": """select vec_id chunk_id, case when vec_id % 6 = 0 then label + 100 else label end label from embeddings where vec_id % 10 <> 1
        union all select vec_id + 1000000, label + 100 from embeddings where vec_id % 6 = 3""",
}


def _recall(index: str, limit: int) -> str:
    return f"""{MEMORIES}, n as (select greatest(1, count(*)) n from embeddings), v as (select m.*, cast(embedding as double[]) embedding from memories m join embeddings on id % (select n from n) = vec_id),
        q as (select m.id + 1 query_id, user_id, entity, stage, mode, thread_name, cast(embedding as double[]) embedding from memories m left join embeddings on (m.id + 1) % (select n from n) = vec_id where m.id % 20 = 0),
        hits as (select query_id, c.*, {_DIST} distance from q join v c using (user_id, entity, stage, mode, thread_name) where importance >= 0.15 and {index}),
        pool as (select * from hits qualify row_number() over (partition by query_id order by distance, memory_id) <= {max(5 * limit, 10)}),
        scored as (select query_id, memory_id, importance, summary, (0.8 / (1 + distance) + 0.2 * (1 - least(greatest((epoch(timestamp '{NOW}') - epoch(coalesce(last_used_at, created_at))) / 604800.0::double, 0), 1))) * (0.8 + 0.4 * importance) score from pool),
        found as (select *, row_number() over (partition by query_id order by score desc, memory_id) rank from scored qualify rank <= {limit}),
        without as (select * from q where query_id not in (select query_id from hits)),
        others as (select query_id, memory_id, importance, summary, importance score, row_number() over (partition by query_id order by importance desc, updated_at desc, m.id desc) rank
            from without join memories m using (user_id, entity, stage, mode, thread_name) where importance >= 0.15 qualify rank <= {limit}),
        recalled as (select query_id, memory_id, importance, summary, score, rank from found union all select query_id, memory_id, importance, summary, score, rank from others)"""


SQL["memory_recall"] = f"with {_recall('true', 3)} select query_id, memory_id, round(score, 6) score, round(importance, 6) importance, summary as text, cast(rank as integer) rank from recalled"
SQL["memory_recall_fallback"] = f"with {_recall('user_id % 10 = 0', 3)} select query_id, memory_id, round(score, 6) score, cast(rank as integer) rank from recalled"
SQL["memory_summary"] = f"""with {_recall('true', 20)} select query_id, string_agg(summary, '；' order by rank) filter (rank <= 3) summary, count(*) memories,
    max(case when rank = 1 then '1. [情景记忆] ' || summary || printf(' (重要性: %.2f, 相关度: %.2f)', importance, score) end) line from recalled group by 1"""
