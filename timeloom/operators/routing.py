"""Incoming turns and the router's replies to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# What a reply may say; the first named default is used for all else.
INTENTS = ("daily_chat", "value_reflection", "stage_event", "relationship", "future_probe", "meta_or_system")
POLICIES = ("persona_only", "persona_first", "balanced", "novel_first", "boundary_only")
DEFAULT_INTENT, DEFAULT_POLICY = "stage_event", "balanced"

# Names of the two modes.
MODES = {
    "temporal": ("0", "temporal", "拟真", "realistic", "simulation"),
    "transparent": ("1", "transparent", "通透"),
}

#: Words that stand for no value.
NOTHING = ("none", "null", "无", "")


def mode_of(mode: Column) -> Column:
    """temporal or transparent; null for a name that is neither."""
    text = F.lower(strip(mode.cast("string")))
    return F.coalesce(*[F.when(text.isin(*names), F.lit(m)) for m, names in MODES.items()])


def normalise_modes(rows: DataFrame, mode: str = "mode") -> tuple[DataFrame, DataFrame]:
    """Rows under the mode's proper name, and the rows whose mode has none."""
    named = rows.withColumn("__mode", mode_of(F.col(mode)))
    return named.where("__mode is not null").withColumn(mode, F.col("__mode")).drop("__mode"), named.where("__mode is null").drop("__mode")


def known_slugs(rows: DataFrame, entities: DataFrame, slug: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Rows with the columns of their slug's entity, and rows of unknown slugs."""
    return rows.join(entities, slug), rows.join(entities, slug, "left_anti")


def validate_turns(turns: DataFrame, stages: list[str], modes: tuple[str, ...] = tuple(MODES), longest_name: int = 128, longest: int = 4000) -> tuple[DataFrame, DataFrame]:
    """Turns that may pass, their message trimmed, and the others with a reject_reason.

    The message has 1 to ``longest`` characters before it is trimmed.
    """
    n = F.char_length(F.coalesce("message", F.lit("")))
    reason = (
        F.when(~F.coalesce(F.col("stage").isin(*stages), F.lit(False)), "stage")
        .when(~F.coalesce(F.col("mode").isin(*modes), F.lit(False)), "mode")
        .when(F.char_length(F.coalesce("thread_name", F.lit(""))) > longest_name, "thread_name")
        .when(n < 1, "empty message")
        .when(n > longest, "long message")
    )
    judged = turns.withColumn("reject_reason", reason)
    return judged.where("reject_reason is null").drop("reject_reason").withColumn("message", strip(F.col("message"))), judged.where("reject_reason is not null")


def with_object(replies: DataFrame, raw: str = "raw", out: str = "__v") -> DataFrame:
    """``replies`` with a reply's JSON object as a variant: within a fence, bare, or between the first and last brace; else null.

    Each step is a column of its own, so that none is computed once for every use.
    """
    text = strip(F.coalesce(F.col(raw), F.lit("")))
    fenced = F.regexp_replace(F.regexp_replace("__text", r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[^\n]*$", "")
    inside = F.when(F.startswith("__text", F.lit("```")), strip(fenced)).otherwise(F.col("__text"))
    first, last = F.locate("{", F.col("__text")), F.length("__text") - F.locate("}", F.reverse("__text")) + 1
    braces = F.when((first > 0) & (last <= F.length("__text")) & (last > first), F.substring("__text", first, last - first + 1))
    rows = replies.withColumn("__text", text).withColumn("__text", inside)
    rows = rows.withColumn("__found", F.coalesce(F.try_parse_json("__text"), F.try_parse_json(braces)))
    return rows.withColumn(out, F.when(F.startswith(F.schema_of_variant("__found"), F.lit("OBJECT")), F.col("__found"))).drop("__text", "__found")


#: The fields of a reply.
FIELDS = ("intent", "confidence", "relationship_target", "future_risk", "retrieval_policy", "persona_k", "novel_k", "web_search_needed", "web_search_query", "rewritten_query", "answer_guidance")


def with_fields(rows: DataFrame, v: str = "__v") -> DataFrame:
    """``rows`` with what each field of the object holds, as text, and its kind: every field is looked up once, and all else follows from these columns."""
    field = F.col(v)
    texts = {f"__text_{f}": F.try_variant_get(field, f"$.{f}", "string") for f in FIELDS}
    kinds = {f"__kind_{f}": F.schema_of_variant(F.try_variant_get(field, f"$.{f}", "variant")) for f in FIELDS}
    return rows.withColumns(texts | kinds)


def _as_text(name: str) -> Column:
    return F.col(f"__text_{name}")


def _kind(name: str) -> Column:
    return F.col(f"__kind_{name}")


def _truthy(name: str) -> Column:
    """As a flag in dynamic languages: false for false, 0, null, the empty text, list and object."""
    kind, text = _kind(name), _as_text(name)
    return F.coalesce(
        F.when(kind == "BOOLEAN", text == "true").when(kind == "STRING", text != "").when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), text.try_cast("double") != 0).when(F.startswith(kind, F.lit("ARRAY")), text != "[]").when(F.startswith(kind, F.lit("OBJECT")), text != "{}"),
        F.lit(False),
    )


def _text(name: str, default: Column) -> Column:
    return F.when(_truthy(name), _as_text(name)).otherwise(default)


def _whole(name: str, default: int) -> Column:
    """An integer from 0 to 8: of a number its whole part, of a text only a whole number."""
    kind, text, number = _kind(name), _as_text(name), _as_text(name).try_cast("double")
    value = F.when(kind == "STRING", strip(text).try_cast("int")).when(kind == "BOOLEAN", (text == "true").cast("int")).otherwise(F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("int"))
    return F.greatest(F.lit(0), F.least(F.lit(8), F.coalesce(value, F.lit(default))))


def _confidence(name: str = "confidence") -> Column:
    kind, text = _kind(name), _as_text(name)
    value = F.when(kind == "STRING", strip(text).try_cast("double")).when(kind == "BOOLEAN", (text == "true").cast("double")).otherwise(text.try_cast("double"))
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.5)))))


def parse_replies(replies: DataFrame, raw: str = "raw", query: str = "query", persona_k: int = 5, novel_k: int = 5) -> DataFrame:
    """``replies`` with a router's decision in eleven columns, ``parsed`` telling whether there was one.

    Unknown intents and policies become the defaults, numbers are clamped,
    words for nothing null, and an empty rewritten query is the original one.
    A reply without an object leaves all at its default.
    """
    rows = with_fields(with_object(replies, raw))
    intent = _text("intent", F.lit(DEFAULT_INTENT))
    policy = _text("retrieval_policy", F.lit(DEFAULT_POLICY))
    target = strip(_as_text("relationship_target"))
    decided = rows.withColumns(
        {
            "parsed": F.col("__v").isNotNull(),
            "intent": F.when(intent.isin(*INTENTS), intent).otherwise(DEFAULT_INTENT),
            "confidence": _confidence(),
            "relationship_target": F.when(~F.lower(target).isin(*NOTHING), target),
            "future_risk": _truthy("future_risk"),
            "retrieval_policy": F.when(policy.isin(*POLICIES), policy).otherwise(DEFAULT_POLICY),
            "persona_k": _whole("persona_k", persona_k),
            "novel_k": _whole("novel_k", novel_k),
            "web_search_needed": _truthy("web_search_needed"),
            "web_search_query": _text("web_search_query", F.lit("")),
            "rewritten_query": _text("rewritten_query", F.col(query)),
            "answer_guidance": _text("answer_guidance", F.lit("")),
        }
    )
    return decided.drop("__v", *[f"__{x}_{f}" for f in FIELDS for x in ("text", "kind")])


def with_defaults(queries: DataFrame, decisions: DataFrame, persona_k: int = 5, novel_k: int = 5) -> DataFrame:
    """Queries (query_id, query) with persona_k, novel_k and query of their decision, or the defaults without one."""
    d = decisions.select("query_id", F.col("persona_k").alias("__p"), F.col("novel_k").alias("__n"), F.col("rewritten_query").alias("__q"))
    got = queries.join(d, "query_id", "left")
    return got.withColumns({"persona_k": F.coalesce("__p", F.lit(persona_k)), "novel_k": F.coalesce("__n", F.lit(novel_k)), "search_query": F.coalesce("__q", "query")}).drop("__p", "__n", "__q")


def wanting(queries: DataFrame, k: str) -> DataFrame:
    """The queries that ask for any result of a route: the others skip its search."""
    return queries.where(F.col(k) > 0)


def build_queries(rows: DataFrame, goal: str, most_events: int = 6) -> DataFrame:
    """``rows`` (entity, stage, stage_name, known_events, query) with search_text: the labelled lines to retrieve by."""
    events = F.slice("known_events", 1, most_events)
    # The lines' labels.
    lines = [
        F.concat(F.lit("角色："), F.col("entity")),
        F.concat(F.lit("时间线阶段："), F.col("stage")),
        F.when(F.col("stage_name") != "", F.concat(F.lit("阶段名称："), F.col("stage_name"))),
        F.when(F.size(events) > 0, F.concat(F.lit("当前阶段已知事件："), F.array_join(events, "；"))),
        F.concat(F.lit("用户问题："), F.col("query")),
        F.lit(goal),
    ]
    return rows.withColumn("search_text", F.concat_ws("\n", *lines))


def digests(profiles: DataFrame, most: int = 8) -> DataFrame:
    """Profiles with known_digest, forbidden_digest and relation_names as the router is told them."""

    # The separators, and what stands for nothing.
    def joined(items: Column, by: str) -> Column:
        return F.coalesce(F.nullif(F.array_join(items, by), F.lit("")), F.lit("无"))

    return profiles.withColumns({"known_digest": joined(F.slice("known_events", 1, most), "；"), "forbidden_digest": joined(F.slice("forbidden_events", 1, most), "；"), "relation_names": joined(F.map_keys("relationships"), "、")})
