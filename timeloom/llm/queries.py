"""The registered query of each operator of this subpackage, with its SQL where SQL can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, minhash, toxicity
from .common import cut, new_path, table
from .decontaminate import find_items
from .exact_dedup import exact_dedup
from .importance import resample
from .mixing import mixture
from .multi_index import nearest_vectors
from .prefix_trie import paths, prefix_trie, with_shared_heads
from .quotes import link_quotes
from .sharding import shuffle_to_shards
from .token_counts import Rollup, count_tokens, deleted, inserted, revised
from .warc import deduplicate, read_archives, write_archives

#: Rank file of the token counts; every worker finds it at this path.
TOKENIZER = os.environ.get("TIMELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _remainder(n: int):
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with an estimate, blank ones leave again, counts of the others are revised.

    The batch of revisions is sent twice and counts once.
    """
    docs = table(spark, sf_dir, "documents")
    estimate = F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / 4).cast("long")
    version = F.lit(os.path.basename(TOKENIZER))
    counted = count_tokens(docs.select("source", "lang", version.alias("version"), estimate.alias("old_tokens"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), "text"), TOKENIZER)
    # Texts are counted once; the deltas of all three batches come from that, a row a document.
    kept = cut(counted)
    first = kept.withColumn("tokens", F.col("old_tokens"))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("inserts", inserted(first))
    rollup.commit("deletes", deleted(first.where("blank")))
    for _ in range(2):
        rollup.commit("revisions", revised(kept.where("not blank")))
    return rollup.totals()


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sample = toxicity.labelled_sample(docs, labels.where(_remainder(3) != 1))
    scored = toxicity.score(docs, toxicity.train(sample))
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "insults", "clauses")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = new_path(spark, "warc"), table(spark, sf_dir, "pages")
    write_archives(deduplicate(pages), path, pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0)
    return read_archives(spark, path).select(F.col("id").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shuffle_to_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return written.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def quoting_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as mail: a turn quotes the turn before it, and what that one quoted a level deeper.

    First turns of every fifth conversation quote words that nobody said.
    """
    text = F.regexp_replace("text", r"\r\n|\r|\n", "\n")
    said = [conversations.select("conv_id", (F.col("turn") + k).alias("turn"), text.alias(f"said{k}")) for k in (1, 2)]

    def quote(c: str, mark: str):
        return F.coalesce(F.concat(F.lit(mark), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n")), F.lit(""))

    unsaid = F.when(F.col("said1").isNull() & (F.col("conv_id") % 5 == 2), F.concat(F.lit("> unsaid "), F.col("conv_id").cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(unsaid, quote("said2", ">> "), quote("said1", "> "), F.coalesce("text", F.lit("")))
    return conversations.join(said[0], ["conv_id", "turn"], "left").join(said[1], ["conv_id", "turn"], "left").select("conv_id", "turn", "role", body.alias("text"))


def op8_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(quoting_messages(table(spark, sf_dir, "conversations")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(_remainder(5) != 0).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_groups(table(spark, sf_dir, "documents"), width=2)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(with_shared_heads(paths(table(spark, sf_dir, "conversations"))))
    return nodes.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("convs").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontamination, op2_token_counts, op3_toxicity, op4_exact_dedup, op5_warc, op6_mixing, op7_sharding, op8_chat_quotes, op9_language_id, op10_near_dedup, op11_prefix_trie, op12_importance, op13_nearest_vectors)
}


def _crc32(x: str, digits: str) -> str:
    """The CRC-32 of a text in SQL, given an expression for its bytes: eight shifts for each."""
    steps = f"list_concat([4294967295::bigint], flatten(list_transform({digits}, lambda b: [b::bigint, -1, -1, -1, -1, -1, -1, -1, -1])))".replace("{x}", x)
    return f"xor(list_reduce({steps}, lambda c, v: case when v >= 0 then xor(c, v) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"


#: Bytes of a number in decimal, and of any text.
_DIGITS = "list_transform(range(1, cast(length({x}) as bigint) + 1), lambda i: ascii(substr({x}, i, 1)))"
_BYTES = "list_transform(range(0, cast(octet_length(encode({x})) as bigint)), lambda i: ('0x' || substr(hex(encode({x})), 2 * i + 1, 2))::int)"

_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = {
    "op1_decontamination": f"""
        with items as (select cast(item_id as varchar) item, {_WORDS.format("text")} w from benchmark where text is not null),
        windows as (select distinct item, m, array_to_string(w[i:i + m - 1], ' ') win
            from (select item, w, least(10, len(w)) m, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from items where len(w) > 0)),
        docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
        places as (select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') win
            from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from docs, (select distinct m from windows) where len(w) >= m)),
        found as (select p.doc_id, p.i, p.m, x.item from places p join windows x using (m, win)),
        hit as (select doc_id, count(distinct i + k) n_hit from (select distinct doc_id, i, unnest(range(0, m)) k from found) group by 1),
        named as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct doc_id, item from found) group by 1)
        select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
            sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
        from docs left join hit using (doc_id) left join named using (doc_id)""",
    "op4_exact_dedup": r"""
        with d as (select doc_id, length(coalesce(text, '')) n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') t from documents),
        g as (select doc_id, t, first_value(doc_id) over (partition by t order by n desc, doc_id) keep_id, count(*) over (partition by t) group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id kept, sha256(t) text_sha256 from g""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') h from pages),
        g as (select page_id, octet_length(encode(h)) n, sha256(h) d, min(page_id) over (partition by h) first from p)
        select page_id, cast(n as bigint) payload_bytes, d payload_digest,
            case when n >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
            case when n >= 100 and page_id <> first then first end refers_to from g""",
    "op6_mixing": r"""
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
        s as (select source, sum(size)::bigint n from d group by 1),
        w as (select source, n, (row_number() over (order by source nulls last) - 1) % 3 + 1 w from s),
        r as (select source, n, w, sum(n) over () - 3 * coalesce(sum(n) over (order by n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) rest,
            sum(w) over () - coalesce(sum(w) over (order by n / w, source nulls last rows between unbounded preceding and 1 preceding), 0) free from w),
        f as (select *, w * rest >= 3 * n * free as capped from r),
        l as (select rest::double / free::double as level from f where not capped order by n / w, source nulls last limit 1),
        t as (select source, n, case when capped then (3 * n)::double else least((3 * n)::double, w * (select level from l)) end target from f),
        h as (select d.*, n source_size, target, case when n > 0 then target / n else 0 end rate, len(d.size::varchar) * 100 + substr(d.size::varchar, 1, 2)::int c,
            ('0x' || substr(sha256('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 12))::bigint / 281474976710656.0::double u,
            ('0x' || substr(sha256('mix:source:' || coalesce(d.source, '')), 1, 12))::bigint / 281474976710656.0::double o from d join t on d.source is not distinct from t.source),
        k as (select *, rate - floor(rate) f, row_number() over (partition by source, c order by u) nth, count(*) over (partition by source, c) n_c, count(*) over (partition by source order by c range unbounded preceding) upto from h),
        m as (select *, max(case when nth <= floor(o + f * upto) - floor(o + f * (upto - n_c)) then u end) over (partition by source, c) bound from k)
        select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u <= bound then 1 else 0 end) as bigint) taken from m""",
    "op8_chat_quotes": r"""
        with m as (select c.conv_id, c.turn, c.role, trim(coalesce(c.text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) content,
            lag(c.turn) over o previous, row_number() over o - 1 as position, first_value(c.turn) over o first_turn, a.text one, b.text two, a.text is null and c.conv_id % 5 = 2 unsaid
            from conversations c left join conversations a on a.conv_id = c.conv_id and a.turn = c.turn - 1 left join conversations b on b.conv_id = c.conv_id and b.turn = c.turn - 2
            window o as (partition by c.conv_id order by c.turn)),
        n as (select *, case when trim(coalesce(one, '')) <> '' then 1 else 0 end + case when trim(coalesce(two, '')) <> '' then 1 else 0 end known from m)
        select conv_id, turn, role, content, case when two is not null then 2 when one is not null or unsaid then 1 else 0 end quote_levels,
            cast(known + case when unsaid then 1 else 0 end as bigint) quoted, cast(known as bigint) linked,
            case when previous is not null then conv_id end reply_conv, previous reply_turn, cast(position as bigint) position,
            conv_id thread_conv, first_turn thread_turn, cast(position as bigint) depth from n""",
    "op11_prefix_trie": f"""
        with own as (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p from conversations where conv_id is not null group by 1),
        h as (select *, {_crc32("cast(conv_id as varchar)", _DIGITS)} % 6 h from own),
        built as (select h.conv_id, list_concat(coalesce(b.p, [])[1:h.h], h.p[h.h + 1:]) p from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100),
        reached as (select conv_id, d, p[1:d] k, len(p) = d is_end from (select conv_id, p, unnest(range(0, len(p) + 1)) d from built)),
        nodes as (select d as depth, k, min(conv_id) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (is_end), '')) ends_sha256 from reached group by 1, 2),
        kids as (select k[1:depth - 1] k, count(*) n from nodes where depth > 0 group by 1),
        rated as (select nodes.*, coalesce(n, 0) n_children, (n_convs - 1) * coalesce(length(k[depth].text), 0) own from nodes left join kids using (k)),
        sums as (select k[1:d] k, sum(own) saved, sum(case when n_children = 0 then 1 else 0 end) leaves from (select *, unnest(range(0, depth + 1)) d from rated) group by 1)
        select r.conv_id, cast(r.depth as bigint) as depth, p.conv_id parent_conv_id, r.n_convs, r.n_children, cast(leaves as bigint) n_leaves, cast(saved as bigint) saved_tokens, r.ends_sha256
        from rated r join sums using (k) left join nodes p on r.depth > 0 and p.k = r.k[1:r.depth - 1]""",
    "op12_importance": f"""
        with texts as (select doc_id id, 0 as of, {_WORDS.format("coalesce(text, '')")} w from documents union all select item_id, 1, {_WORDS.format("coalesce(text, '')")} from benchmark),
        runs as (select row_number() over () r, id, of, len(w) n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f from texts),
        each as (select r, of, unnest(f) f from runs),
        hashed as (select f, {_crc32("f", _BYTES)} % 10000 bucket from (select distinct f from each)),
        met as (select r, of, bucket from each join hashed using (f)),
        n as (select bucket, count(*) filter (of = 0) s, count(*) filter (of = 1) t from met group by 1),
        gains as (select bucket, cast(floor(1000 * ln((t + 1) * (sum(s) over () + 10000)::double / ((s + 1) * (sum(t) over () + 10000)::double))) as bigint) gain from n),
        weighed as (select r, count(*) n_features, cast(floor(sum(gain)::double / count(*)) as bigint) weight from met join gains using (bucket) where of = 0 group by 1),
        scored as (select id doc_id, n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
            coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(cast(id as varchar), '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) score
            from runs left join weighed using (r) where of = 0),
        placed as (select *, n_words >= 20 able, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) place, count(*) filter (n_words >= 20) over () n from scored)
        select doc_id, n_features, weight, score, case when able and place <= 25 * n // 100 then place end as rank from placed""",
}
