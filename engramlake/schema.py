"""Record layouts and fixed vocabularies of the memory store."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies of the stored records.
ENTRY_TYPES = ("identity", "preference", "fact", "plan", "context", "other")
ENTRY_STATUSES = ("active", "archived")
JOB_KINDS = ("recall", "extract", "dream", "index")
JOB_STATUSES = ("pending", "running", "completed", "partial", "failed")

# Limits and weights.
MAX_KEYWORDS = 12
DEFAULT_IMPORTANCE = 0.5
KEYWORD_BONUS = 0.15
KEYWORD_ONLY = 0.3
GROUP_CAPACITY = 30
GRAPH_NEIGHBOURS = 10
LOG_CAPACITY = 500
RERANK_WIDENING = 3
DEFAULT_PAGE, MAX_PAGE = 20, 100
RETENTION_DAYS, DECAY_DAYS, JOB_DAYS = 7, 180, 7
CARD_MAX_DELETED, CARD_MIN_CHARS = 0.8, 20
SNAPSHOT_LINE_CHARS = 100
FAILURE_LIMIT = 3
INDEX_SCHEMA_VERSION = 5

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SOURCE_MESSAGE = _struct(role=_S, speaker_label=_S, created_at=_S, content_lines=T.ArrayType(_S), content=_S, transcript_lines=T.ArrayType(_S))
ORIGIN = _struct(messages=T.ArrayType(SOURCE_MESSAGE))
MEMORY = _struct(
    memory_id=_S, preset_id=_S, speaker_keys=T.ArrayType(_S), type=_S, status=_S, content=_S, keywords=T.ArrayType(_S), summary=_S, sentiment=_S, importance=_D,
    source_conversation_id=_S, source_label=_S, source_origins=T.ArrayType(ORIGIN), created_at=_TS, updated_at=_TS,
)
MEMORY_SPEAKER = _struct(id=_S, preset_id=_S, speaker_key=_S, memory_id=_S)
SNAPSHOT = _struct(id=_S, preset_id=_S, conversation_id=_S, query=_S, items=T.ArrayType(_struct(final_text=_S, searches=T.ArrayType(_struct(texts=T.ArrayType(_S), keywords=T.ArrayType(_S))), memory_ids=T.ArrayType(_S))), created_at=_TS)
JOB = _struct(id=_S, preset_id=_S, conversation_id=_S, kind=_S, status=_S, input=_S, detail=_S, error=_S, created_at=_TS, started_at=_TS, finished_at=_TS, updated_at=_TS)
PROFILE = _struct(id=_S, preset_id=_S, speaker_key=_S, speaker_label=_S, content=_S, source_memory_ids=T.ArrayType(_S), created_at=_TS, updated_at=_TS)
SPEAKER = _struct(id=_S, preset_id=_S, speaker_key=_S, speaker_label=_S, speaker_aliases=T.ArrayType(_S), speaker_id=_S, platform=_S, created_at=_TS, updated_at=_TS)
PERSONA = _struct(preset_id=_S, card=_S, raw_hash=_S, source=_S, total_lines=T.IntegerType(), deleted_lines=T.IntegerType(), used_raw_fallback=T.BooleanType(), updated_at=_TS)
MIGRATION = _struct(id=_S, applied_at=_TS)
INDEX_MANIFEST = _struct(schema_version=T.IntegerType(), dimension=T.IntegerType(), embedding_model_id=_S, storage_engine=_S, vector_extension_version=_S, generation=_S, built_at=_L)
INDEX_MEMORY = _struct(memory_id=_S, preset_id=_S, source_conversation_id=_S, status=_S, type=_S, content_hash=_S, keywords_hash=_S, updated_at=_L, embedding=T.ArrayType(T.FloatType()))
INDEX_KEYWORD = _struct(memory_id=_S, keyword=_S)
INDEX_STATE = _struct(preset_id=_S, state=_S, expected_count=T.IntegerType(), indexed_count=T.IntegerType(), last_error=_S, updated_at=_L)
LOG_MESSAGE = _struct(conversation_id=_S, message_id=_S, user_id=_S, name=_S, content=_S, timestamp=_L, role=_S, origin=_S)
