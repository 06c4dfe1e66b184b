"""Schemas of the nested inputs."""

from pyspark.sql import types as T

_S, _L = T.StringType(), T.ArrayType(T.StringType())

#: English column names and the keys that the profile files use for them; keys are fixed values of the format.
PROFILE_KEYS = {
    "positioning": "阶段定位",
    "persona_state": "当前人格状态",
    "beliefs": "核心信念",
    "mood": "情绪底色",
    "style": "语言风格",
    "known_events": "已知事件",
    "forbidden_events": "禁止知道的未来事件",
    "relationships": "与其他角色的关系状态",
    "tendencies": "典型回答倾向",
    "drift": "容易发生的人设漂移",
    "rules": "人设一致性校验规则",
    "enrichment": "小说融合增强",
    "card": "RAG知识卡片",
}

#: Labels of the fields inside the enrichment, fixed values of the chunk format.
ENRICHMENT_LABELS = {
    "stage_anchor": "小说阶段锚点",
    "event_distillation": "小说事件蒸馏",
    "persona_texture": "人格纹理",
    "dialogue_mimic": "语气模拟",
    "content_boost": "小说融合补强",
}

ENRICHMENT = T.StructType([T.StructField("stage_anchor", _S), T.StructField("event_distillation", _L), T.StructField("persona_texture", _L), T.StructField("dialogue_mimic", _L), T.StructField("content_boost", _S)])

CARD_META = T.StructType([T.StructField(c, _S) for c in ("character", "timeline_stage", "global_timeline_anchor", "knowledge_type", "anti_future_sight_level", "source")])

CARD = T.StructType([T.StructField("card_id", _S), T.StructField("content", _S), T.StructField("metadata", CARD_META)])

_KINDS = {"beliefs": _L, "known_events": _L, "forbidden_events": _L, "tendencies": _L, "drift": _L, "rules": _L, "relationships": T.MapType(_S, _S), "enrichment": ENRICHMENT, "card": CARD}

#: Profile rows as the files have them.
PROFILE_FILE = T.StructType(
    [T.StructField(c, _S) for c in ("skill_id", "record_type", "character", "stage_id", "stage_name")]
    + [T.StructField("stage_order", T.IntegerType())]
    + [T.StructField(key, _KINDS.get(name, _S)) for name, key in PROFILE_KEYS.items()]
    + [T.StructField("_corrupt", _S)]
)

CHUNK_FILE = T.StructType([T.StructField("chunk_id", _S), T.StructField("text", _S), T.StructField("metadata", T.MapType(_S, _S)), T.StructField("_corrupt", _S)])
