"""Profile rows: one per entity and stage, with nested details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schemas import ENRICHMENT_LABELS, PROFILE_KEYS
from ..functions.tables import top
from ..functions.text import join_present, strip

_LISTS = ("beliefs", "known_events", "forbidden_events", "tendencies", "drift", "rules")


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}："), value)


def stage_rows(profiles: DataFrame) -> DataFrame:
    """Stage rows only; meta rows go."""
    return profiles.where("record_type = 'stage'")


def profile_for(queries: DataFrame, profiles: DataFrame, entity: str = "entity", stage: str = "stage") -> tuple[DataFrame, DataFrame]:
    """Each query with the profile of its entity and stage, and the queries whose stage has none.

    Of several rows for a stage the last counts: by ``file`` and ``row_number``
    as ``read_profiles`` gives them. Without these columns the rows have no
    order, and stages must be unique.
    """
    order = [F.desc(c) for c in ("file", "row_number") if c in profiles.columns and "row_number" in profiles.columns] or [F.lit(0)]
    one = top(profiles, [entity, stage], order, 1, "__rank").drop("__rank", "row_number")
    own = [c for c in one.columns if c not in (entity, stage)]
    found = queries.join(one.withColumn("__found", F.lit(True)), [entity, stage], "left")
    return found.where("__found").drop("__found"), found.where("__found is null").drop("__found", *own)


def profile_text(p: DataFrame, out: str = "text") -> DataFrame:
    """One labelled text a profile: lists joined in a line, relations as name and text."""
    # The lines' labels, here and in ``profile_chunks``.
    relations = F.coalesce(F.array_join(F.transform(F.map_entries("relationships"), lambda e: F.concat(e["key"], F.lit("："), e["value"])), "；"), F.lit(""))
    lines = [
        _labelled("角色", F.coalesce("character", "card.metadata.character", F.lit(""))),
        _labelled("阶段", F.concat_ws(" ", _text("stage_id"), _text("stage_name"))),
        _labelled("阶段顺序", _text(F.col("stage_order").cast("string"))),
    ]
    for name, key in PROFILE_KEYS.items():
        if name in _LISTS:
            lines.append(_labelled(key, _text(F.array_join(name, "；"))))
        elif name == "relationships":
            lines.append(_labelled(key, relations))
        elif name == "enrichment":
            for field, label in ENRICHMENT_LABELS.items():
                value = F.col(f"enrichment.{field}")
                lines.append(_labelled(label, _text(F.array_join(value, "；") if field not in ("stage_anchor", "content_boost") else value)))
        elif name == "card":
            lines.append(_labelled(key, _text("card.content")))
        else:
            lines.append(_labelled(key, _text(name)))
    return p.withColumn(out, F.concat_ws("\n", *lines))


def profile_metadata(p: DataFrame, source: Column | None = None, default_character: str | None = None) -> DataFrame:
    """Flat metadata; what the card states goes before the row itself.

    Without ``source`` it is the card's, and a missing character is
    ``default_character``.
    """
    meta = F.col("card.metadata")
    return p.select(
        "skill_id",
        "record_type",
        F.coalesce(meta["character"], "character", F.lit(default_character)).alias("character"),
        F.coalesce(meta["timeline_stage"], "stage_id").alias("timeline_stage"),
        "stage_id",
        "stage_name",
        "stage_order",
        F.col("card.card_id").alias("card_id"),
        meta["knowledge_type"].alias("knowledge_type"),
        meta["anti_future_sight_level"].alias("anti_future_sight_level"),
        meta["global_timeline_anchor"].alias("global_timeline_anchor"),
        (source if source is not None else meta["source"]).alias("source"),
        F.lit("jsonl").alias("source_format"),
    )


def profile_chunks(p: DataFrame, source: str | None = "file") -> DataFrame:
    """Five chunks a profile, one for each kind, with flat metadata; nothing is shuffled."""
    character = F.coalesce("card.metadata.character", "character", F.lit("unknown"))
    stage = F.coalesce("stage_id", F.lit("unknown"))
    head = [_labelled("角色", character), _labelled("阶段", F.concat(stage, F.lit(" "), _text("stage_name")))]
    relations = _text(F.array_join(F.transform(F.map_entries("relationships"), lambda e: F.concat(F.lit("- "), e["key"], F.lit("："), _text(e["value"]))), "\n"))

    def line(name: str) -> Column:
        return _labelled(PROFILE_KEYS[name], join_present(F.col(name)) if name in _LISTS else _text(name))

    enrichment = [_labelled(label, _text(f"enrichment.{f}") if f in ("stage_anchor", "content_boost") else join_present(F.col(f"enrichment.{f}"))) for f, label in ENRICHMENT_LABELS.items()]
    kinds = {
        "persona_core": [*head, *map(line, ("positioning", "persona_state", "beliefs", "mood", "style"))],
        "knowledge_boundary": [*head, *map(line, ("known_events", "forbidden_events", "tendencies", "drift", "rules"))],
        "relationships": [*head, _labelled(PROFILE_KEYS["relationships"], F.lit("")), relations],
        "novel_enrichment": [*head, *enrichment],
        "rag_card": [*head, _labelled(PROFILE_KEYS["card"], _text("card.content"))],
    }
    made = F.array(*[F.struct(F.lit(k).alias("chunk_kind"), strip(F.concat_ws("\n", *lines)).alias("text")) for k, lines in kinds.items()])
    rows = p.withColumn("__chunk", F.explode(made))
    chunk_id = F.concat(F.lit("persona_"), F.replace(character, F.lit(" "), F.lit("_")), F.lit("_"), stage, F.lit("_"), F.col("__chunk.chunk_kind"))
    return rows.select(
        chunk_id.alias("chunk_id"),
        F.col("__chunk.text").alias("text"),
        F.col("__chunk.chunk_kind").alias("chunk_kind"),
        F.lit("persona_profile").alias("source_type"),
        F.coalesce("card.metadata.character", "character").alias("character"),
        F.coalesce("card.metadata.timeline_stage", "stage_id").alias("timeline_stage"),
        *[F.col(c) for c in ("skill_id", "record_type", "stage_id", "stage_name", "stage_order")],
        F.col("card.card_id").alias("card_id"),
        *[F.col(f"card.metadata.{c}").alias(c) for c in ("knowledge_type", "anti_future_sight_level", "global_timeline_anchor")],
        (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
        F.lit("jsonl").alias("source_format"),
    )


def enrich(profiles: DataFrame, enrichments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles with the enrichment of their stage, and the number of stage rows that had one.

    ``enrichments`` has stage_id and the struct enrichment. Its content_boost is
    added to the card's text unless that has it already, so a second run
    changes nothing.
    """
    new = enrichments.select("stage_id", F.col("enrichment").alias("__new"))
    got = profiles.join(new, "stage_id", "left")
    boost, content = F.col("__new.content_boost"), F.coalesce("card.content", F.lit(""))
    added = F.when(boost.isNotNull() & ~F.contains(content, boost), strip(F.concat_ws(" ", content, boost))).otherwise(F.col("card.content"))
    changed = got.withColumn("enrichment", F.coalesce("__new", "enrichment")).withColumn("card", F.when(F.col("__new").isNotNull(), F.struct(F.col("card.card_id").alias("card_id"), added.alias("content"), F.col("card.metadata").alias("metadata"))).otherwise(F.col("card")))
    count = got.where("__new is not null and record_type = 'stage'").agg(F.count(F.lit(1)).alias("enriched"))
    return changed.drop("__new").select(*profiles.columns), count


def inventory_gaps(declared: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stages that the inventory (character, active_stages) declares without rows, and rows it doesn't declare."""
    want = declared.select("character", F.explode("active_stages").alias("stage_id")).distinct()
    have = stage_rows(profiles).select("character", "stage_id").distinct()
    missing = want.exceptAll(have).withColumn("gap", F.lit("no row"))
    return missing.unionByName(have.exceptAll(want).withColumn("gap", F.lit("not declared")))
