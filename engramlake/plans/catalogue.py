"""Queries over the example tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions import text, vector
from engramlake.operators import browse, cluster, facts, index, log, neighbours, registry, search, transfer
from engramlake.schema import MEMORY, PROFILE, SPEAKER
from engramlake.sources.kept import Kept
from engramlake.sources.tables import Views, sql_trim, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}
WORDS = ["the", " Of ", "de", ""]
WORDS_SQL = "('the', 'of', 'de')"
NOW = "2024-02-15 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def query(name: str, views: str = "", sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_views(views, sql)
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


def ms(c: str):
    return F.unix_millis(c)


COS = "round(list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 6)"

# ---- search ----


def _knn_sql(where: str, k: int) -> str:
    return f"""SELECT text_no, memory_id, cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY text_no ORDER BY cosine DESC, memory_id) AS n
  FROM (SELECT q.text_no, m.memory_id, {COS} AS cosine FROM mem m, qvec q WHERE {where})) WHERE n <= {k}"""


@query("knn_exact", "mem qvec", _knn_sql("m.preset_id = 'preset-1' AND m.status = 'active'", 10))
def _(v):
    return search.knn(v.rows, v.qvec, 10, preset="preset-1")


@query("knn_isolated", "mem qvec", _knn_sql("m.preset_id = 'preset-1' AND m.status = 'active' AND (m.source_conversation_id = 'conv-1' OR m.source_conversation_id IS NULL) AND m.type IN ('fact', 'preference', 'plan')", 5))
def _(v):
    return search.knn(v.rows, v.qvec, 5, preset="preset-1", conversation="conv-1", types=["fact", "preference", "plan"])


@query("knn_excluded", "mem qvec", _knn_sql("m.status = 'active' AND m.memory_id NOT IN (1, 2, 3, 5, 8)", 8))
def _(v):
    return search.knn(v.rows, v.qvec, 8, exclude=[1, 2, 3, 5, 8])


@query("neighbour_search", "mem qvec", _knn_sql("m.preset_id = 'preset-1' AND m.status = 'active'", 10))
def _(v):
    """knn by the persisted cells: built and published, then searched with the exact certificate."""
    kept = Kept(v.spark)
    built = neighbours.build(v.rows.select("memory_id", "preset_id", "status", "type", "source_conversation_id", "embedding"), f"{kept.folder}/neighbours", kept.table, dimension=64, cell_rows=128)
    return kept.result(neighbours.search(built, v.qvec, 10, stored=kept.table, preset="preset-1")[0], "neighbour-search")


MATCH = f"""matched AS (SELECT k.memory_id, count(*) AS match_count FROM mem_kw k JOIN mem m ON m.memory_id = k.memory_id WHERE k.keyword IN {WORDS_SQL} AND m.status = 'active' GROUP BY k.memory_id)"""


@query("keyword_match", "mem mem_kw", f"{MATCH} SELECT * FROM matched")
def _(v):
    return search.keyword_match(v.rows, v.mem_kw, WORDS)


HYBRID = f"""{MATCH},
scored AS (SELECT q.text_no, m.memory_id, {COS} AS c, coalesce(k.match_count, 0) AS match_count FROM mem m CROSS JOIN qvec q LEFT JOIN matched k ON k.memory_id = m.memory_id WHERE m.status = 'active'),
boosted AS (SELECT text_no, memory_id, CASE WHEN c >= 0.1 THEN c ELSE CAST(0 AS DOUBLE) END AS cosine, match_count,
  round(CASE WHEN c >= 0.1 THEN c + CAST(0.15 AS DOUBLE) * match_count WHEN match_count > 0 THEN CAST(0.3 AS DOUBLE) * match_count END, 6) AS boosted FROM scored),
hits AS (SELECT text_no, memory_id, cosine, match_count, boosted FROM (SELECT *, row_number() OVER (PARTITION BY text_no ORDER BY boosted DESC, memory_id) AS n FROM boosted WHERE boosted IS NOT NULL) WHERE n <= 15)"""


@query("hybrid_search", "mem mem_kw qvec", f"{HYBRID} SELECT * FROM hits")
def _(v):
    return search.hybrid(v.rows, v.mem_kw, v.qvec, WORDS, 15, 0.1)


@query("hybrid_no_keyword", "mem qvec", f"""SELECT text_no, memory_id, cosine, CAST(0 AS BIGINT) AS match_count, cosine AS boosted FROM ({_knn_sql("m.status = 'active' AND m.preset_id = 'preset-2'", 200)})""")
def _(v):
    return search.hybrid(v.rows, v.mem_kw, v.qvec, [" "], 200, 0.0, preset="preset-2")


MULTI = f"""{HYBRID},
best AS (SELECT memory_id, cosine, match_count, boosted FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY boosted DESC, cosine DESC, text_no) AS b FROM hits) WHERE b = 1),
merged AS (SELECT *, row_number() OVER (ORDER BY boosted DESC, memory_id) AS rank FROM best QUALIFY rank <= 15)"""


def _multi(v):
    return search.multi_search(v.rows, v.mem_kw, v.qvec, WORDS, 15, 0.1)


@query("multi_search", "mem mem_kw qvec", f"{MULTI} SELECT * FROM merged")
def _(v):
    return _multi(v)


@query("search_detailed", "mem mem_kw qvec", f"{MULTI} SELECT h.*, m.type, m.importance, m.source_label, epoch_ms(m.updated_at) AS updated_ms FROM merged h JOIN mem m USING (memory_id)")
def _(v):
    return search.hydrate(_multi(v), v.rows, "type", "importance", "source_label", ms("updated_at").alias("updated_ms"))


@query("rerank_merge", "mem mem_kw qvec", f"""{MULTI},
scores AS (SELECT memory_id, max(relevance) AS relevance FROM (SELECT memory_id, CAST((memory_id * t.i) % 7 AS DOUBLE) AS relevance FROM merged, (SELECT unnest([3, 5]) AS i) t WHERE memory_id % 4 <> 0) GROUP BY memory_id)
SELECT m.memory_id, m.rank, s.relevance FROM merged m JOIN scores s USING (memory_id) ORDER BY s.relevance DESC, m.rank LIMIT 6""")
def _(v):
    hits = _multi(v)
    rankings = hits.where("memory_id % 4 <> 0").select("memory_id", F.explode(F.array(F.lit(3), F.lit(5))).alias("i")).select("memory_id", (F.col("memory_id") * F.col("i") % 7).cast("double").alias("relevance"))
    return search.rerank(hits, rankings, 6)


@query("rerank_widened", "mem mem_kw qvec", f"""{HYBRID},
best AS (SELECT memory_id, cosine, match_count, boosted FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY boosted DESC, cosine DESC, text_no) AS b FROM hits) WHERE b = 1),
wide AS (SELECT *, row_number() OVER (ORDER BY boosted DESC, memory_id) AS place FROM best QUALIFY place <= 15),
given AS (SELECT memory_id, place, CASE WHEN length(content) % 4 <> 0 THEN CAST(length(content) % 7 AS DOUBLE) END AS relevance FROM wide JOIN mem USING (memory_id))
SELECT memory_id, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, place) AS INTEGER) AS rank, FALSE AS failed FROM given WHERE relevance IS NOT NULL QUALIFY rank <= 5""")
def _(v):
    score = lambda texts: [None if len(t) % 4 == 0 else len(t) % 7 for t in texts]
    return search.reranked_search(v.rows, v.mem_kw, v.qvec, WORDS, 5, 0.1, score, content=v.rows)


@query("recall_after_failure", "chat", """q AS (SELECT conversation_id, seq FROM chat WHERE role = 'user')
SELECT conversation_id, seq, TRUE AS runs FROM q""")
def _(v):
    """Every recall fails, so every message may run."""
    asks = v.chat.where("role = 'user'").select("conversation_id", "seq")
    return log.throttle(v.chat, 6, failed=asks)


@query("persona_epochs", "mem", """SELECT DISTINCT preset_id, CASE WHEN preset_id = 'preset-1' THEN 'by hand' ELSE 'new' END AS card, CAST(CASE WHEN preset_id = 'preset-1' THEN 1 ELSE 2 END AS BIGINT) AS epoch,
CASE WHEN preset_id = 'preset-1' THEN 'manual,manual' ELSE 'stale' END AS refused FROM mem""")
def _(v):
    """One stored card a preset, one of them by hand; of two generated cards each the one with the stale epoch loses."""
    preset = v.mem.select("preset_id").distinct()
    hand = F.col("preset_id") == "preset-1"
    cards = preset.select("preset_id", F.when(hand, "by hand").otherwise("old").alias("card"), F.lit("h0").alias("raw_hash"), F.when(hand, "manual").otherwise("generated").alias("source"), F.lit(1).cast("long").alias("epoch"))
    change = lambda card, epoch: preset.select("preset_id", F.lit(card).alias("card"), F.lit("h" + card).alias("raw_hash"), F.lit("generated").alias("source"), F.lit(epoch).cast("long").alias("epoch"))
    after, lost = registry.set_personas(cards, change("new", 1).unionByName(change("late", 0)))
    why = lost.groupBy("preset_id").agg(F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("refused"))
    return after.join(why, "preset_id", "left").select("preset_id", "card", "epoch", "refused")


@query("candidate_stats", "mem mem_kw qvec", f"""matched AS (SELECT DISTINCT k.memory_id FROM mem_kw k JOIN mem m USING (memory_id) WHERE k.keyword IN {WORDS_SQL} AND m.status = 'active'),
near AS (SELECT memory_id FROM (SELECT m.memory_id, row_number() OVER (ORDER BY {COS} DESC, m.memory_id) AS n FROM mem m, qvec q WHERE q.text_no = 0 AND m.status = 'active') WHERE n <= 30)
SELECT (SELECT count(*) FROM mem WHERE status = 'active') AS filtered, (SELECT count(*) FROM matched) AS keyword, (SELECT count(*) FROM near) AS semantic, (SELECT count(*) FROM near JOIN matched USING (memory_id)) AS overlap""")
def _(v):
    return search.candidate_stats(v.rows, v.mem_kw, v.qvec.where("text_no = 0"), WORDS, 30)


@query("valid_vectors", "", """SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS valid FROM embeddings""")
def _(v):
    return v.table("embeddings").select("vec_id", vector.is_valid(F.col("embedding"), 64).alias("valid"))


@query("vector_codec", "", "SELECT vec_id, embedding[1] AS first, embedding[64] AS last, TRUE AS same FROM embeddings")
def _(v):
    e = v.table("embeddings").withColumn("back", vector.decode(vector.encode(F.col("embedding"))))
    return e.select("vec_id", F.element_at("back", 1).alias("first"), F.element_at("back", 64).alias("last"), (F.col("back") == F.col("embedding")).alias("same"))


# ---- lists ----

LISTED = "SELECT memory_id, type, status, epoch_ms(updated_at) AS updated_ms FROM mem"
KEYWORD_HIT = "(lower(content) LIKE '%the%' OR lower(summary) LIKE '%the%' OR lower(sentiment) LIKE '%the%' OR len(list_filter(keywords, lambda k: lower(k) LIKE '%the%')) > 0)"


def _listed(df):
    return df.select("memory_id", "type", "status", ms("updated_at").alias("updated_ms"))


@query("list_filter", "mem", f"{LISTED} WHERE type = 'fact' AND status = 'active' AND list_contains(speaker_keys, 'u2') AND {KEYWORD_HIT} ORDER BY updated_at DESC, memory_id LIMIT 20")
def _(v):
    return _listed(browse.list_memories(v.mem, type="fact", status="active", speaker="u2", keyword=" The "))


@query("list_memories", "mem", f"{LISTED} WHERE preset_id = 'preset-0' ORDER BY updated_at DESC, memory_id LIMIT 20")
def _(v):
    return _listed(browse.list_memories(v.mem.where("preset_id = 'preset-0'"), status="all"))


@query("list_ids", "mem", f"SELECT memory_id FROM mem WHERE status = 'active' AND {KEYWORD_HIT}")
def _(v):
    return v.mem.where(browse.memory_filter(status="active", keyword="the")).select("memory_id")


@query("text_match", "mem", "SELECT memory_id FROM mem WHERE status = 'active' AND (lower(content) LIKE '%glad%' OR lower(summary) LIKE '%glad%' OR len(list_filter(keywords, lambda k: lower(k) LIKE '%on%')) > 0 OR lower(content) LIKE '%on%' OR lower(summary) LIKE '%on%')")
def _(v):
    return v.mem.where(F.col("status") == "active").where(browse.text_match("glad", "content", "summary") | browse.text_match("ON", "content", "summary")).select("memory_id")


@query("facets", "mem", """grid AS (SELECT s.s AS status, t.t AS type FROM (SELECT unnest(['active', 'archived', 'all']) AS s) s, (SELECT unnest(['identity', 'preference', 'fact', 'plan', 'context', 'other', 'all']) AS t) t)
SELECT g.status, g.type, count(m.memory_id) AS n FROM grid g LEFT JOIN mem m ON m.preset_id = 'preset-0' AND (g.status = 'all' OR m.status = g.status) AND (g.type = 'all' OR m.type = g.type) GROUP BY g.status, g.type""")
def _(v):
    return browse.facets(v.mem.where("preset_id = 'preset-0'"))


@query("paginate", "mem", f"{LISTED} WHERE status = 'active' ORDER BY updated_at DESC, memory_id LIMIT 25 OFFSET 50")
def _(v):
    return _listed(browse.list_memories(v.mem, page=3, size=25, status="active"))


@query("list_total", "mem", f"SELECT count(*) AS total FROM mem WHERE type = 'fact' AND status = 'active' AND list_contains(speaker_keys, 'u2') AND {KEYWORD_HIT}")
def _(v):
    return browse.list_total(v.mem, type="fact", status="active", speaker="u2", keyword=" The ")


@query("list_jobs", "job", "SELECT job_id, kind, status, (epoch_us(created_at) // 1000) AS created_ms FROM job WHERE kind = 'extract' AND status = 'failed' ORDER BY created_at DESC, job_id LIMIT 50")
def _(v):
    return browse.paginate(v.job.where("kind = 'extract' and status = 'failed'"), [F.col("created_at").desc(), "job_id"], 1, 50).select("job_id", "kind", "status", ms("created_at").alias("created_ms"))


@query("list_profiles", "profile", "SELECT profile_id, speaker_label, epoch_ms(updated_at) AS updated_ms FROM profile WHERE preset_id = 'preset-1' ORDER BY updated_at DESC, speaker_label, profile_id LIMIT 20 OFFSET 20")
def _(v):
    return browse.paginate(v.profile.where("preset_id = 'preset-1'"), [F.col("updated_at").desc(), "speaker_label", "profile_id"], 2).select("profile_id", "speaker_label", ms("updated_at").alias("updated_ms"))


@query("list_speakers", "speaker", "SELECT preset_id, speaker_key, speaker_label, place FROM speaker WHERE preset_id = 'preset-3' AND speaker_key IN ('u3', 'u7')")
def _(v):
    return v.speaker.where("preset_id = 'preset-3' and speaker_key in ('u3', 'u7')").select("preset_id", "speaker_key", "speaker_label", "place")


@query("keyset_page", "mem", "SELECT memory_id, (SELECT CASE WHEN count(*) > 40 THEN max(CASE WHEN n = 40 THEN memory_id END) END FROM (SELECT memory_id, row_number() OVER (ORDER BY memory_id) AS n FROM mem WHERE memory_id > 100 AND preset_id = 'preset-2') WHERE n <= 41) AS next_cursor FROM mem WHERE memory_id > 100 AND preset_id = 'preset-2' ORDER BY memory_id LIMIT 40")
def _(v):
    return browse.keyset_page(v.mem.where("preset_id = 'preset-2'").select("memory_id"), "memory_id", 100, 40)


@query("get_by_id", "mem", "SELECT memory_id, preset_id, type, status, importance FROM mem WHERE memory_id = 42")
def _(v):
    return v.mem.where("memory_id = 42").select("memory_id", "preset_id", "type", "status", "importance")


@query("multi_get", "mem", "SELECT memory_id, type, importance, source_label FROM mem WHERE preset_id = 'preset-1' AND memory_id IN (1, 5, 6, 9, 77777)")
def _(v):
    return v.mem.where(F.col("preset_id") == "preset-1").where(F.col("memory_id").isin(1, 5, 6, 9, 77777)).select("memory_id", "type", "importance", "source_label")


@query("active_scan", "mem", "SELECT memory_id, type, importance, epoch_ms(created_at) AS created_ms, len(keywords) AS n_keywords FROM mem WHERE preset_id = 'preset-3' AND status = 'active'")
def _(v):
    return v.mem.where("preset_id = 'preset-3' and status = 'active'").select("memory_id", "type", "importance", ms("created_at").alias("created_ms"), F.size("keywords").cast("long").alias("n_keywords"))


@query("inventory_counts", "mem", "SELECT preset_id, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active FROM mem GROUP BY preset_id")
def _(v):
    return browse.counts_by_preset(v.mem)


@query("distinct_presets", "mem job profile", "SELECT DISTINCT preset_id FROM (SELECT preset_id FROM mem UNION SELECT preset_id FROM job WHERE kind <> 'index' UNION SELECT preset_id FROM profile)")
def _(v):
    return browse.distinct_presets(v.mem, v.job.where("kind <> 'index'"), v.profile)


@query("preset_catalog", "mem", """s AS (SELECT 'preset-3' AS p, 0 AS source, 0 AS place UNION ALL SELECT 'preset-9', 0, 1 UNION ALL SELECT preset_id, 1, min(memory_id) FROM mem GROUP BY preset_id)
SELECT p AS preset_id, CAST(source AS INTEGER) AS source, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY source, place) AS n FROM s) WHERE n = 1""")
def _(v):
    configured = v.spark.createDataFrame([(" preset-3", 0), ("preset-9", 1), (" ", 2)], "preset_id string, place long")
    return browse.preset_catalogue(configured, v.mem.groupBy("preset_id").agg(F.min("memory_id").alias("place")))


# ---- index ----


@query("index_hashes", "mem", """SELECT memory_id, sha256(content) AS content_hash, sha256(CAST(to_json(list_sort(list_distinct(list_transform(keywords, lambda k: lower(k))))) AS VARCHAR)) AS keywords_hash FROM mem""")
def _(v):
    return v.mem.select("memory_id", text.content_hash("content").alias("content_hash"), text.keywords_hash("keywords").alias("keywords_hash"))


@query("derived_ids", "mem_speaker", "SELECT memory_id, speaker_key, sha256(CAST(memory_id AS VARCHAR) || chr(0) || speaker_key) AS row_id, sha256(preset_id || chr(0) || speaker_key) AS speaker_id, sha256('qq' || chr(0) || speaker_key) AS account_key FROM mem_speaker")
def _(v):
    s = v.mem_speaker
    return s.select("memory_id", "speaker_key", text.derived_id(F.col("memory_id").cast("string"), F.col("speaker_key")).alias("row_id"), text.derived_id("preset_id", "speaker_key").alias("speaker_id"), text.speaker_key(F.lit(" qq "), F.concat(F.lit(" "), "speaker_key")).alias("account_key"))


def _drifted(v):
    """An index that lags behind: some rows missing, with other content, other state, or left over."""
    built = index.build(v.mem, v.mem.select("memory_id", "embedding"), 64).where("memory_id % 10 <> 3")
    built = built.withColumn("content_hash", F.when(F.col("memory_id") % 10 == 4, "old").otherwise(F.col("content_hash"))).withColumn("status", F.when(F.col("memory_id") % 10 == 5, "archived").otherwise(F.col("status")))
    return built.unionByName(built.where("memory_id < 5").withColumn("memory_id", F.col("memory_id") + 1_000_000))


@query("reconcile_diff", "mem", """SELECT memory_id, preset_id, CASE WHEN memory_id % 10 IN (3, 4) THEN 'replace' WHEN memory_id % 10 = 5 AND status = 'active' THEN 'preserve' ELSE 'noop' END AS action FROM mem
UNION ALL SELECT memory_id + 1000000, preset_id, 'delete' FROM mem WHERE memory_id < 5 AND memory_id % 10 <> 3""")
def _(v):
    return index.reconcile(v.mem, _drifted(v))


@query("index_build", "mem", "SELECT memory_id, preset_id, sha256(content) AS content_hash, epoch_ms(updated_at) AS updated_at, embedding[1] AS first FROM mem")
def _(v):
    return index.build(v.mem, v.mem.select("memory_id", "embedding"), 64).select("memory_id", "preset_id", "content_hash", "updated_at", F.element_at("embedding", 1).alias("first"))


@query("index_apply", "mem", """SELECT memory_id, CASE WHEN memory_id % 10 IN (3, 4) THEN sha256(content) ELSE sha256(content) END AS content_hash, status, embedding[1] AS first FROM mem""")
def _(v):
    old = _drifted(v)
    plan = index.reconcile(v.mem, old)
    docs = index.documents(v.mem).join(plan.select("memory_id", "action"), "memory_id").join(v.mem.select("memory_id", F.col("embedding").alias("e")), "memory_id")
    upserts = docs.where("action in ('replace', 'preserve')").withColumn("embedding", F.when(F.col("action") == "replace", F.col("e"))).drop("action", "e")
    out = index.apply_mutation(old, upserts, plan.where("action = 'delete'"))
    return out.select("memory_id", "content_hash", "status", F.element_at("embedding", 1).alias("first"))


@query("snapshot_missing", "mem", "ids AS (SELECT unnest([1, 2, 3, 3, 900001, 900002]) AS memory_id) SELECT DISTINCT i.memory_id, m.memory_id IS NULL AS missing, sha256(m.content) AS content_hash FROM ids i LEFT JOIN mem m USING (memory_id)")
def _(v):
    ids = v.spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 900001, 900002)], "memory_id long")
    return index.snapshot(index.build(v.mem, v.mem.select("memory_id", "embedding"), 64), ids)


STATES_SQL = """s AS (SELECT preset_id, CASE WHEN min(memory_id) % 2 = 1 THEN 'dirty' ELSE 'ready' END AS state, CASE WHEN min(memory_id) % 2 = 1 THEN 'late ' || preset_id END AS last_error FROM mem GROUP BY preset_id)"""


def _states(v):
    """A state a preset of the memories; every second one lags behind."""
    odd = F.col("m") % 2 == 1
    rows = v.mem.groupBy("preset_id").agg(F.min("memory_id").alias("m"))
    return rows.select("preset_id", F.when(odd, "dirty").otherwise("ready").alias("state"), F.when(odd, F.concat(F.lit("late "), "preset_id")).alias("last_error"))


@query("state_rollup", "mem", f"""{STATES_SQL},
e AS (SELECT count(*) AS presets, bool_or(state = 'dirty') AS dirty, min_by(last_error, preset_id) FILTER (WHERE last_error IS NOT NULL) AS last_error FROM s)
SELECT CASE WHEN dirty THEN 'dirty' ELSE 'ready' END AS state, presets, last_error FROM e UNION ALL SELECT 'building', presets, last_error FROM e UNION ALL SELECT 'unavailable', presets, last_error FROM e UNION ALL SELECT 'ready', 0, NULL""")
def _(v):
    rows = _states(v)
    return index.roll_up(rows).unionByName(index.roll_up(rows, manifest_missing=True)).unionByName(index.roll_up(rows, unavailable=True, building=True)).unionByName(index.roll_up(rows.where("false")))


@query("rebuild_reason", "mem", "SELECT memory_id, ['missing', 'engine', 'extension', 'schema', 'model', 'dimension', NULL][memory_id % 7 + 1] AS reason FROM mem")
def _(v):
    """A manifest a memory, each with another fault, the last one with none."""
    case = F.col("memory_id") % 7
    some = lambda right, wrong, at: F.when(case == 0, None).when(case == at, wrong).otherwise(right)
    manifests = v.mem.select(
        "memory_id", some(5, 4, 3).alias("schema_version"), some("pg", "x", 1).alias("storage_engine"), some("0.8", "0.7", 2).alias("vector_extension_version"),
        some("m1", "m0", 4).alias("embedding_model_id"), some(64, 32, 5).alias("dimension"),
    )
    return index.rebuild_reason(manifests, engine="pg", extension="0.8", model="m1", dimension=64).select("memory_id", "reason")


@query("migrate_index", "mem", "SELECT memory_id, CAST(NULL AS VARCHAR) AS source_conversation_id, status FROM mem")
def _(v):
    return index.upgrade(v.mem.select("memory_id", "status", F.lit(True).alias("is_consolidated"))).select("memory_id", "source_conversation_id", "status")


@query("embed_reuse", "mem", "SELECT memory_id, memory_id % 3 = 0 AND memory_id % 2 = 0 AS reused, CASE WHEN memory_id % 3 = 0 AND memory_id % 2 = 0 THEN embedding[1] ELSE CAST(length(content) AS FLOAT) END AS first FROM mem")
def _(v):
    legacy = v.mem.where("memory_id % 3 = 0").select("memory_id", "embedding", F.when(F.col("memory_id") % 2 == 0, "m1").otherwise("m0").alias("embedding_model_id"))
    fake = lambda c: F.array_repeat(F.length(c).cast("float"), 64)
    return index.embed(v.mem, legacy, "m1", 64, fake).select("memory_id", "reused", F.element_at("embedding", 1).alias("first"))


# ---- speakers and profiles ----


@query("speaker_index", "mem_speaker", "SELECT * FROM mem_speaker")
def _(v):
    return v.mem_speaker


@query("speaker_links", "mem_speaker", "SELECT preset_id, speaker_key, memory_id FROM mem_speaker WHERE preset_id = 'preset-1' AND speaker_key IN ('u1', 'u4')")
def _(v):
    return v.mem_speaker.where("preset_id = 'preset-1' and speaker_key in ('u1', 'u4')").orderBy("speaker_key", "memory_id")


@query("ids_by_user", "mem_speaker", "SELECT DISTINCT memory_id FROM mem_speaker WHERE sha256('qq' || chr(0) || speaker_key) = sha256('qq' || chr(0) || 'u3')")
def _(v):
    keyed = v.mem_speaker.withColumn("key", text.speaker_key(F.lit("qq"), "speaker_key"))
    return keyed.where(F.col("key") == text.speaker_key(F.lit(" qq"), F.lit("u3 "))).select("memory_id").distinct()


GROUPS = """live AS (SELECT s.preset_id, s.speaker_key, m.memory_id, epoch_ms(m.updated_at) AS ms, row_number() OVER (PARTITION BY s.preset_id, s.speaker_key ORDER BY coalesce(m.importance, CAST(0.5 AS DOUBLE)) DESC, m.updated_at DESC, m.memory_id) AS n, count(*) OVER (PARTITION BY s.preset_id, s.speaker_key) AS matched FROM mem_speaker s JOIN mem m USING (memory_id)),
groups AS (SELECT preset_id, speaker_key, max(matched) AS matched, count(*) AS selected, max(ms) AS latest_ms, list(memory_id ORDER BY n) AS memory_ids FROM live WHERE n <= 5 AND matched >= 4 GROUP BY preset_id, speaker_key)"""


def _groups(v):
    return registry.profile_groups(v.mem_speaker, v.rows, least=4, most=5)


@query("profile_groups", "mem mem_speaker", f"{GROUPS} SELECT preset_id, speaker_key, matched, selected, latest_ms, array_to_string(memory_ids, ',') AS memory_ids FROM groups")
def _(v):
    return _groups(v).withColumn("memory_ids", F.array_join("memory_ids", ","))


@query("profile_totals", "mem mem_speaker", f"{GROUPS} SELECT count(*) AS speakers, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(selected) AS BIGINT) AS selected FROM groups")
def _(v):
    return registry.profile_totals(_groups(v))


@query("profile_fresh", "mem mem_speaker", f"{GROUPS} SELECT preset_id, speaker_key, ascii(substr(speaker_key, 2)) % 3 = 1 AS fresh FROM groups")
def _(v):
    g = _groups(v)
    kind = F.ascii(F.substring("speaker_key", 2, 1)) % 3
    profiles = g.select("preset_id", "speaker_key", F.when(kind == 0, F.slice("memory_ids", 1, 1)).otherwise(F.reverse("memory_ids")).alias("source_memory_ids"), F.timestamp_millis(F.col("latest_ms") + F.when(kind == 1, 1).otherwise(0)).alias("updated_at"))
    profiles = profiles.withColumn("source_memory_ids", F.when(kind == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.col("source_memory_ids")))
    return registry.profile_fresh(g, profiles).select("preset_id", "speaker_key", "fresh")


@query("profile_canonical", "profile", "SELECT preset_id, speaker_key, profile_id, content FROM (SELECT *, row_number() OVER (PARTITION BY preset_id, speaker_key ORDER BY created_at, profile_id) AS n FROM profile) WHERE n = 1")
def _(v):
    return registry.canonical_profiles(v.profile).select("preset_id", "speaker_key", "profile_id", "content")


@query("resolve_labels", "speaker", """wanted AS (SELECT unnest([' ALIAS 7', 'alias   12 ', 'Customer#000000003', 'nobody']) AS label),
names AS (SELECT speaker_key, place, 0 AS pos, speaker_label AS name FROM speaker UNION ALL SELECT speaker_key, place, 1, speaker_aliases[1] FROM speaker UNION ALL SELECT speaker_key, place, 2, speaker_aliases[2] FROM speaker),
folded AS (SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS k, arg_max(speaker_key, place * 10 + pos) AS speaker_key FROM names GROUP BY 1)
SELECT w.label, f.speaker_key FROM wanted w LEFT JOIN folded f ON f.k = lower(trim(regexp_replace(w.label, '\\s+', ' ', 'g')))""")
def _(v):
    wanted = v.spark.createDataFrame([(" ALIAS 7",), ("alias   12 ",), ("Customer#000000003",), ("nobody",)], "label string")
    return registry.resolve_labels(wanted, v.speaker)


@query("register_missing", "mem_speaker speaker", """SELECT m.preset_id, m.speaker_key, 'label-' || min(m.memory_id) AS speaker_label FROM mem_speaker m WHERE NOT EXISTS (SELECT 1 FROM speaker s WHERE s.preset_id = m.preset_id AND s.speaker_key = m.speaker_key AND s.place < 60) GROUP BY m.preset_id, m.speaker_key""")
def _(v):
    seen = v.mem_speaker.select("preset_id", "speaker_key", F.concat(F.lit("label-"), F.col("memory_id").cast("string")).alias("speaker_label"), F.col("memory_id").alias("place"))
    return registry.register_missing(v.speaker.where("place < 60"), seen)


@query("speaker_coverage", "mem_speaker speaker", "SELECT DISTINCT m.preset_id, m.speaker_key, 'user:' || substr(m.speaker_key, 1, 8) AS speaker_label FROM mem_speaker m WHERE NOT EXISTS (SELECT 1 FROM speaker s WHERE s.preset_id = m.preset_id AND s.speaker_key = m.speaker_key AND s.place < 40)")
def _(v):
    return registry.coverage(v.mem_speaker, v.speaker.where("place < 40").select("preset_id", "speaker_key"))


@query("reconcile_speaker", "speaker", """who AS (SELECT * FROM (VALUES ('preset-1', 'u5', 'New Name', 'acc5', 'qq'), ('preset-2', 'zz', 'Fresh', 'acc2', 'qq'), ('preset-0', 'none', 'Nobody', 'acc-none', 'qq')) AS t(p, k, l, a, pf)),
found AS (SELECT DISTINCT w.p, w.k, s.speaker_key, s.created_at FROM who w JOIN speaker s ON s.preset_id = w.p AND (s.speaker_key = w.k OR (s.speaker_id = w.a AND (s.platform IS NULL OR s.platform = w.pf))))
SELECT w.p AS preset_id, w.k AS speaker_key, w.l AS speaker_label, (SELECT CAST(epoch_ms(min(created_at)) AS VARCHAR) FROM found f WHERE f.p = w.p AND f.k = w.k) AS created_ms,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT speaker_key)), ',') FROM found f WHERE f.p = w.p AND f.k = w.k), '') AS merged_keys FROM who w""")
def _(v):
    who = v.spark.createDataFrame([("preset-1", "u5", "New Name", "acc5", "qq"), ("preset-2", "zz", "Fresh", "acc2", "qq"), ("preset-0", "none", "Nobody", "acc-none", "qq")], "preset_id string, speaker_key string, speaker_label string, speaker_id string, platform string")
    return registry.reconcile_speakers(v.speaker, who).select("preset_id", "speaker_key", "speaker_label", ms("created_at").cast("string").alias("created_ms"), F.array_join("merged_keys", ",").alias("merged_keys"))


@query("merge_profiles", "profile", """rows AS (SELECT *, CASE WHEN speaker_key IN ('u1', 'u2', 'u3') THEN 'merged' ELSE speaker_key END AS k FROM profile)
SELECT preset_id, k AS speaker_key, arg_max(profile_id, epoch_ms(updated_at) * 100000 + profile_id) AS profile_id, arg_max(content, epoch_ms(updated_at) * 100000 + profile_id) AS content, array_to_string(list_sort(list_distinct(flatten(list(source_memory_ids)))), ',') AS source_memory_ids FROM rows GROUP BY preset_id, k""")
def _(v):
    key = F.when(F.col("speaker_key").isin("u1", "u2", "u3"), "merged").otherwise(F.col("speaker_key"))
    keys = v.profile.select("preset_id", key.alias("speaker_key"), F.col("speaker_key").alias("old_key")).distinct()
    return registry.merge_profiles(v.profile, keys).withColumn("source_memory_ids", F.array_join("source_memory_ids", ","))


@query("profile_render", "profile", """asked AS (SELECT * FROM (VALUES ('r1', 1, 'preset-1', 'u5'), ('r1', 2, 'preset-1', 'u1'), ('r1', 3, 'preset-1', 'u5'), ('r2', 1, 'preset-2', 'u0'), ('r2', 2, 'preset-2', 'u2'), ('r3', 1, 'preset-2', 'u1')) AS t(request, place, preset_id, speaker_key)),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY preset_id, speaker_key ORDER BY created_at, profile_id) AS n FROM profile) WHERE n = 1),
first AS (SELECT request, preset_id, speaker_key, min(place) AS place FROM asked GROUP BY 1, 2, 3)
SELECT f.request, string_agg(o.speaker_label || '的人物画像：' || chr(10) || o.content, chr(10) || chr(10) ORDER BY f.place) AS rendered FROM first f JOIN one o USING (preset_id, speaker_key) WHERE trim(o.content) <> '' GROUP BY f.request""")
def _(v):
    rows = [("r1", 1, "preset-1", "u5"), ("r1", 2, "preset-1", "u1"), ("r1", 3, "preset-1", "u5"), ("r2", 1, "preset-2", "u0"), ("r2", 2, "preset-2", "u2"), ("r3", 1, "preset-2", "u1")]
    asked = v.spark.createDataFrame(rows, "request string, place int, preset_id string, speaker_key string")
    return registry.render_profiles(asked, facts.latest(v.profile, ["preset_id", "speaker_key"], "created_at", "profile_id"))


@query("injection", "profile", f"""SELECT profile_id, concat_ws(chr(10) || chr(10), CASE WHEN {sql_trim('content')} <> '' THEN '## 用户画像' || chr(10) || {sql_trim('content')} END,
 CASE WHEN profile_id % 4 <> 0 THEN '## 短期记忆' || chr(10) || speaker_label END) AS section FROM profile""")
def _(v):
    label = F.when(F.col("profile_id") % 4 != 0, F.concat(F.lit(" "), "speaker_label", F.lit("\t"))).otherwise(F.lit(" \n"))
    return v.profile.select("profile_id", registry.injection(F.concat(F.lit("\n"), "content"), label).alias("section"))


def _personas(v):
    stored = v.spark.createDataFrame([("preset-0", "own", "h0", "manual"), ("preset-1", "old", "h1", "generated"), ("preset-2", "old", "h2", "generated")], "preset_id string, card string, raw_hash string, source string")
    new = v.mem.select("preset_id").distinct().select("preset_id", F.lit("new").alias("card"), text.sha256("preset_id").alias("raw_hash"), F.lit("generated").alias("source"))
    return stored, new


@query("persona_upsert", "mem", "SELECT DISTINCT preset_id, CASE preset_id WHEN 'preset-0' THEN 'own' ELSE 'new' END AS card, CASE preset_id WHEN 'preset-0' THEN 'manual' ELSE 'generated' END AS source FROM mem")
def _(v):
    return registry.upsert_personas(*_personas(v)).select("preset_id", "card", "source")


@query("persona_stale", "", "SELECT * FROM (VALUES ('preset-0', 'manual', FALSE), ('preset-1', 'generated', TRUE), ('preset-2', 'generated', TRUE)) AS t(preset_id, source, stale)")
def _(v):
    stored, new = _personas(v)
    return registry.stale_personas(stored, new.select("preset_id", F.col("preset_id").alias("raw")))


@query("import_remap", "mem", """SELECT sha256('import' || chr(0) || 'entry' || chr(0) || 'target' || chr(0) || memory_id) AS import_id, 'target' AS preset_id, content, memory_id % 6 = 0 AS replaces FROM mem WHERE preset_id = 'preset-2'""")
def _(v):
    records = v.mem.where("preset_id = 'preset-2'").select("memory_id", "content")
    had = registry.import_entries("target", records.where("memory_id % 6 = 0"), v.spark.createDataFrame([], "import_id string")).select("import_id")
    return registry.import_entries("target", records, had)


@query("export_doc", "mem", """SELECT preset_id, memory_id, memory_id AS id, type, status, content, keywords FROM mem""")
def _(v):
    rows = registry.export_lines(v.mem)
    return rows.select("preset_id", "memory_id", F.from_json("document", "id long, type string, status string, content string, keywords array<string>").alias("d")).select("preset_id", "memory_id", "d.*")


def _documents(v):
    """Every memory as a document of one of the five versions; some have an unknown type, some an origin of no known role."""
    i, none = F.col("memory_id"), F.lit(None).cast("string")
    message = F.struct(F.when(i % 10 == 4, "bot").otherwise("user").alias("role"), none.alias("speaker_label"), none.alias("created_at"), F.array("content").alias("content_lines"), F.col("content").alias("content"), F.array(F.lit("line")).alias("transcript_lines"))
    entries = v.mem.where("content is not null").withColumns({
        "source_origins": F.array(F.struct(F.array(message).alias("messages"))), "type": F.when(i % 10 == 3, "odd").otherwise(F.col("type")), "memory_id": i.cast("string")}).select(*MEMORY.names)
    empty = [v.spark.createDataFrame([], layout) for layout in (PROFILE, SPEAKER)]
    out = transfer.export_documents(entries, *empty, now())
    number = F.regexp_extract("document", r'"id":"(\d+)"', 1).cast("long")
    return out.select(F.regexp_replace("document", F.lit('^\\{"version":5'), F.concat(F.lit('{"version":'), (number % 5 + 1).cast("string"))).alias("document"))


@query("import_documents", "mem", """SELECT sha256('import' || chr(0) || 'entry' || chr(0) || 'target' || chr(0) || memory_id) AS memory_id, CASE WHEN memory_id % 5 >= 2 THEN array_to_string(speaker_keys, ',') ELSE '' END AS speaker_keys, type, status, content,
 array_to_string(keywords, ',') AS keywords, summary, sentiment, importance, source_conversation_id, CASE WHEN memory_id % 5 >= 3 THEN source_label END AS source_label, content AS origin, epoch_ms(created_at) AS created_ms, epoch_ms(updated_at) AS updated_ms
FROM mem WHERE content IS NOT NULL AND memory_id % 10 NOT IN (3, 4)""")
def _(v):
    found = transfer.records(_documents(v)).where("fault is null")
    rows = transfer.imported(found, "target", now(), v.speaker)["entries"]
    return rows.select("memory_id", F.array_join("speaker_keys", ",").alias("speaker_keys"), "type", "status", "content", F.array_join("keywords", ",").alias("keywords"), "summary", "sentiment", "importance", "source_conversation_id", "source_label",
        F.col("source_origins")[0]["messages"][0]["content"].alias("origin"), ms("created_at").alias("created_ms"), ms("updated_at").alias("updated_ms"))


@query("import_faults", "mem", """SELECT memory_id % 5 + 1 AS version, preset_id AS source, CASE memory_id % 10 WHEN 3 THEN 'type' ELSE 'sourceOrigins[0].messages[0].role' END AS fault, count(*) AS records FROM mem WHERE content IS NOT NULL AND memory_id % 10 IN (3, 4) GROUP BY ALL""")
def _(v):
    return transfer.records(_documents(v)).where("fault is not null").groupBy(F.col("version").cast("long").alias("version"), "source", "fault").agg(F.count(F.lit(1)).alias("records"))


@query("import_speakers", "mem", """SELECT DISTINCT k.w AS speaker_key, 'user:' || substr(k.w, 1, 8) AS speaker_label FROM mem, unnest(speaker_keys) AS k(w)
WHERE content IS NOT NULL AND status = 'active' AND memory_id % 10 NOT IN (3, 4) AND memory_id % 5 >= 2 AND k.w NOT IN ('u1', 'u2')""")
def _(v):
    """Speakers made up for active entries; u1 and u2 are known."""
    found = transfer.records(_documents(v)).where("fault is null")
    return transfer.imported(found, "target", now(), v.speaker.where("speaker_key in ('u1', 'u2')"))["speakers"].select("speaker_key", "speaker_label")


# ---- entries and jobs ----


@query("normalize_entry", "mem", f"""SELECT memory_id, {sql_trim('content')} AS content, CASE WHEN memory_id % 4 <> 0 THEN nullif({sql_trim('summary')}, '') END AS summary,
 array_to_string((list_concat(['dup'], list_filter(keywords, lambda x: x <> 'dup')))[1:12], ',') AS keywords, array_to_string(list_sort(list_distinct(['u9', 'u' || (memory_id % 15)])), ',') AS speaker_keys,
 CASE WHEN memory_id % 9 <> 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(memory_id % 30 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(1 AS DOUBLE))) END AS importance FROM mem""")
def _(v):
    i = F.col("memory_id")
    raw = v.mem.withColumns({
        "content": F.concat(F.lit("\t "), "content", F.lit("　")), "summary": F.when(i % 4 == 0, " \n").otherwise(F.concat(F.lit(" "), "summary")), "sentiment": F.lit(" "), "source_conversation_id": F.lit(""),
        "keywords": F.concat(F.array(F.lit(" dup "), F.lit("dup"), F.lit(" ")), F.transform("keywords", lambda k: F.concat(F.lit(" "), k))),
        "speaker_keys": F.array(F.lit(" u9"), F.concat(F.lit("u"), (i % 15).cast("string")), F.lit("u9 "), F.lit("")), "importance": F.when(i % 9 != 0, (i % 30).cast("double") / F.lit(10.0) - F.lit(1.0)),
    })
    return facts.normalized(raw).select("memory_id", "content", "summary", F.array_join("keywords", ",").alias("keywords"), F.array_join("speaker_keys", ",").alias("speaker_keys"), "importance")


@query("append_extracted", "mem", f"SELECT memory_id, status, content, epoch_ms(created_at) AS created_ms FROM mem WHERE memory_id >= 10 UNION ALL SELECT memory_id, 'active', 'new', epoch_ms({NOW_SQL}) FROM mem WHERE memory_id < 10")
def _(v):
    base = v.mem.select("memory_id", "status", "content", "summary", "sentiment", "keywords", "speaker_keys", "importance", "source_conversation_id", "created_at", "updated_at")
    new = base.where("memory_id < 10").withColumn("content", F.lit(" new "))
    return facts.append(base, new, now()).select("memory_id", "status", "content", ms("created_at").alias("created_ms"))


@query("apply_patch", "mem", f"""SELECT memory_id, CASE WHEN memory_id % 4 = 1 THEN 'changed' ELSE content END AS content, CASE WHEN memory_id % 4 = 2 THEN 'other' ELSE type END AS type, CASE WHEN memory_id % 4 IN (1, 2) THEN CAST(0.9 AS DOUBLE) ELSE importance END AS importance,
 CASE WHEN memory_id % 4 IN (1, 2) THEN epoch_ms({NOW_SQL}) ELSE epoch_ms(updated_at) END AS updated_ms, memory_id % 4 = 1 AS content_changed FROM mem""")
def _(v):
    patch = v.mem.where("memory_id % 4 in (1, 2)").select("memory_id", F.when(F.col("memory_id") % 4 == 1, " changed").alias("content"), F.when(F.col("memory_id") % 4 == 2, "other").alias("type"), F.lit(0.9).alias("importance"))
    return facts.apply_patch(v.mem, patch, now()).select("memory_id", "content", "type", "importance", ms("updated_at").alias("updated_ms"), "content_changed")


@query("patch_lists", "mem", """p AS (SELECT memory_id, preset_id, status, CASE WHEN memory_id % 4 = 1 THEN ['k' || memory_id, 'b'] ELSE keywords END AS keywords, CASE WHEN memory_id % 4 = 2 THEN ['a1', 'z' || memory_id] ELSE speaker_keys END AS speaker_keys FROM mem)
SELECT memory_id, array_to_string(keywords, ',') AS keywords, array_to_string(speaker_keys, ',') AS speaker_keys, CASE WHEN status = 'active' THEN len(speaker_keys) ELSE 0 END AS links FROM p""")
def _(v):
    i = F.col("memory_id")
    patch = v.mem.where("memory_id % 4 in (1, 2)").select("memory_id", F.when(i % 4 == 1, F.array(F.concat(F.lit(" k"), i.cast("string")), F.lit("b"), F.lit("b "))).alias("keywords"), F.when(i % 4 == 2, F.array(F.concat(F.lit("z"), i.cast("string")), F.lit(" a1"), F.lit(""))).alias("speaker_keys"))
    out = facts.apply_patch(v.mem, patch, now())
    links = index.speaker_rows(out).groupBy("memory_id").agg(F.count(F.lit(1)).alias("links"))
    return out.join(links, "memory_id", "left").select("memory_id", F.array_join("keywords", ",").alias("keywords"), F.array_join("speaker_keys", ",").alias("speaker_keys"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query("split_archives", "mem", f"SELECT memory_id, CASE WHEN memory_id % 6 = 2 THEN 'archived' ELSE status END AS status, CASE WHEN memory_id % 6 = 2 AND status = 'active' THEN epoch_ms({NOW_SQL}) ELSE epoch_ms(updated_at) END AS updated_ms FROM mem")
def _(v):
    parts = v.mem.where("memory_id % 6 in (1, 2)").select(F.col("memory_id").alias("parent_id"), F.explode(F.sequence(F.lit(1), (F.col("memory_id") % 6).cast("int"))).alias("part")).withColumn("content", F.lit("x"))
    return facts.archive_split(v.mem, parts, now()).select("memory_id", "status", ms("updated_at").alias("updated_ms"))


@query("merge_archives", "mem", f"""g AS (SELECT memory_id // 8 AS group_id, preset_id FROM mem WHERE status = 'active' AND memory_id % 4 <> 3), d AS (SELECT group_id, preset_id FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT memory_id, CASE WHEN d.group_id IS NOT NULL AND memory_id % 4 <> 3 THEN 'archived' ELSE status END AS status FROM mem LEFT JOIN d ON d.group_id = memory_id // 8 AND d.preset_id = mem.preset_id""")
def _(v):
    groups = v.mem.where("memory_id % 4 <> 3").select(F.expr("memory_id div 8").alias("group_id"), "memory_id")
    return facts.archive_merged(v.mem, groups, now()).select("memory_id", "status")


@query("snapshot_delete", "job", "SELECT 'id' AS way, job_id AS id FROM job WHERE job_id <> 7 UNION ALL SELECT 'conversation', job_id FROM job WHERE conversation_id IS DISTINCT FROM '7' UNION ALL SELECT 'preset', job_id FROM job WHERE preset_id <> 'preset-2'")
def _(v):
    rows = v.job.select(F.col("job_id").alias("id"), "preset_id", "conversation_id")
    left = [("id", facts.delete_snapshots(rows, id=7)), ("conversation", facts.delete_snapshots(rows, conversation="7")), ("preset", facts.delete_snapshots(rows, preset="preset-2"))]
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(way).alias("way"), "id") for way, df in left])


@query("profile_reviewed", "profile", f"SELECT profile_id, content, CASE WHEN profile_id % 4 = 0 THEN '7,9' ELSE array_to_string(source_memory_ids, ',') END AS sources, CASE WHEN profile_id % 4 = 0 THEN epoch_ms({NOW_SQL}) ELSE epoch_ms(updated_at) END AS updated_ms FROM profile")
def _(v):
    reviewed = v.profile.where("profile_id % 4 = 0").select("profile_id", F.array(F.lit(7).cast("long"), F.lit(9).cast("long")).alias("source_memory_ids"))
    return registry.mark_reviewed(v.profile, reviewed, now()).select("profile_id", "content", F.array_join("source_memory_ids", ",").alias("sources"), ms("updated_at").alias("updated_ms"))


@query("archive", "mem", f"SELECT memory_id, CASE WHEN memory_id % 3 = 0 THEN 'archived' ELSE status END AS status, CASE WHEN memory_id % 3 = 0 AND status = 'active' THEN epoch_ms({NOW_SQL}) ELSE epoch_ms(updated_at) END AS updated_ms FROM mem")
def _(v):
    return facts.archive(v.mem, v.mem.where("memory_id % 3 = 0"), now()).select("memory_id", "status", ms("updated_at").alias("updated_ms"))


@query("split_memory", "mem", "SELECT m.memory_id AS parent_id, p.i AS part, 'part ' || p.i AS content, m.preset_id, m.source_conversation_id, m.source_label, 'active' AS status FROM mem m, (SELECT unnest([1, 2, 3]) AS i) p WHERE m.status = 'active' AND m.memory_id % 6 IN (1, 2) AND p.i <= m.memory_id % 6 + 0 AND m.memory_id % 6 = 2")
def _(v):
    parts = v.mem.where("memory_id % 6 in (1, 2)").select(F.col("memory_id").alias("parent_id"), F.explode(F.sequence(F.lit(1), (F.col("memory_id") % 6).cast("int"))).alias("part")).withColumn("content", F.concat(F.lit("part "), F.col("part").cast("string")))
    return facts.split(v.mem, parts)


@query("merge_memories", "mem", """g AS (SELECT CASE WHEN memory_id < 250 THEN memory_id % 60 ELSE memory_id // 2 END AS group_id, * FROM mem WHERE status = 'active')
SELECT group_id, preset_id, array_to_string(list(memory_id ORDER BY memory_id), ',') AS parents,
 CASE WHEN count(DISTINCT coalesce(source_conversation_id, '<null>')) = 1 THEN min(source_conversation_id) END AS source_conversation_id,
 CASE WHEN count(DISTINCT coalesce(source_conversation_id, '<null>')) = 1 AND count(DISTINCT coalesce(source_label, '<null>')) = 1 THEN min(source_label) END AS source_label
FROM g GROUP BY group_id, preset_id HAVING count(*) >= 2""")
def _(v):
    groups = v.mem.select(F.when(F.col("memory_id") < 250, F.col("memory_id") % 60).otherwise(F.expr("memory_id div 2")).alias("group_id"), "memory_id")
    return facts.merge(v.mem, groups).withColumn("parents", F.array_join("parents", ","))


@query("merge_origins", "chat", "SELECT conversation_id AS group_id, min(seq) AS place, role || (length(content) % 3) AS content FROM chat GROUP BY ALL")
def _(v):
    """One origin a turn; transcript lines differ everywhere and do not count."""
    said = F.concat("role", (F.length("content") % 3).cast("string"))
    message = F.struct("role", F.lit(None).cast("string").alias("speaker_label"), F.lit("2024").alias("created_at"), F.array(said).alias("content_lines"), said.alias("content"), F.array(F.col("seq").cast("string")).alias("transcript_lines"))
    origins = v.chat.select(F.col("conversation_id").alias("group_id"), F.col("seq").alias("place"), F.array(message).alias("messages"))
    return facts.merge_origins(origins).select("group_id", "place", F.col("messages")[0]["content"].alias("content"))


@query("merge_union", "mem", """o AS (SELECT memory_id // 8 AS group_id, preset_id, memory_id, t.i AS place, CASE t.i WHEN 0 THEN 'c' || (memory_id % 3) ELSE 'x' || (memory_id % 4) END AS content FROM mem, (SELECT unnest([0, 1]) AS i) t WHERE status = 'active'),
g AS (SELECT group_id, preset_id FROM o GROUP BY ALL HAVING count(DISTINCT memory_id) >= 2), f AS (SELECT group_id, preset_id, content, min(memory_id * 10 + place) AS p FROM o GROUP BY ALL)
SELECT group_id, preset_id, string_agg(content, ',' ORDER BY p) AS origins FROM f JOIN g USING (group_id, preset_id) GROUP BY ALL""")
def _(v):
    """Two origins a memory; the transcript lines differ everywhere and do not count."""
    i = F.col("memory_id")
    none = F.lit(None).cast("string")
    origin = lambda content: F.struct(F.array(F.struct(F.lit("user").alias("role"), none.alias("speaker_label"), F.lit("2024").alias("created_at"), F.array(content).alias("content_lines"), content.alias("content"), F.array(i.cast("string")).alias("transcript_lines"))).alias("messages"))
    entries = v.mem.withColumn("source_origins", F.array(origin(F.concat(F.lit("c"), (i % 3).cast("string"))), origin(F.concat(F.lit("x"), (i % 4).cast("string")))))
    merged = facts.merge_with_origins(entries, v.mem.select(F.expr("memory_id div 8").alias("group_id"), "memory_id"))
    return merged.select("group_id", "preset_id", F.array_join(F.transform("source_origins", lambda o: o["messages"][0]["content"]), ",").alias("origins"))


@query("delete_cascade", "mem mem_speaker", "SELECT 'entry' AS kind, memory_id FROM mem WHERE memory_id % 9 <> 0 UNION ALL SELECT 'link', memory_id FROM mem_speaker WHERE memory_id % 9 <> 0")
def _(v):
    entries, links = facts.delete(v.mem, v.mem_speaker, v.mem.where("memory_id % 9 = 0"))
    return entries.select(F.lit("entry").alias("kind"), "memory_id").unionByName(links.select(F.lit("link").alias("kind"), "memory_id"))


@query("clear_preset", "mem", "SELECT memory_id FROM mem WHERE preset_id <> 'preset-1'")
def _(v):
    return v.mem.where("preset_id <> 'preset-1'").select("memory_id")


@query("retention", "mem", "SELECT memory_id FROM mem WHERE status = 'archived' AND epoch_ms(TIMESTAMP '2024-05-01') - epoch_ms(updated_at) >= 7 * 86400000 AND epoch_ms(TIMESTAMP '2024-05-01') - epoch_ms(updated_at) >= (7 + coalesce(importance, CAST(0.5 AS DOUBLE)) * 180) * 86400000")
def _(v):
    return facts.expired(v.mem, F.lit("2024-05-01").cast("timestamp")).select("memory_id")


@query("stale_jobs", "job", "SELECT job_id, CASE WHEN status IN ('pending', 'running') AND preset_id = 'preset-1' AND kind = 'extract' THEN 'failed' ELSE status END AS status FROM job")
def _(v):
    return facts.stale_jobs(v.job, now(), preset="preset-1", kind="extract").select("job_id", "status")


@query("job_expiry", "job", "last AS (SELECT max(updated_at) AS t FROM job) SELECT job_id FROM job, last WHERE (epoch_us(updated_at) // 1000) >= (epoch_us(t) // 1000) - 7 * 86400000")
def _(v):
    last = v.job.agg(F.max("updated_at").alias("_t"))
    return facts.unexpired_jobs(v.job.crossJoin(last), F.col("_t")).select("job_id")  # last is one row


@query("job_status", "job", "SELECT preset_id, kind, status, count(*) AS n FROM job GROUP BY ALL")
def _(v):
    return v.job.groupBy("preset_id", "kind", "status").agg(F.count(F.lit(1)).alias("n"))


@query("job_lifecycle", "job", f"SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'completed' WHEN job_id % 3 = 0 THEN 'running' ELSE 'pending' END AS status, job_id % 3 = 0 AND job_id % 6 <> 0 AS started, job_id % 6 = 0 AS finished FROM job WHERE kind = 'dream'")
def _(v):
    jobs = facts.new_jobs(v.job.where("kind = 'dream'").select("job_id", "preset_id", "conversation_id", "kind"), now())
    minutes = lambda n: F.expr(f"timestamp '{NOW}' + interval {n} minutes")
    running = jobs.where("job_id % 3 = 0").select("job_id", F.lit("running").alias("status"), minutes(1).alias("at"))
    done = jobs.where("job_id % 6 = 0").select("job_id", F.lit("completed").alias("status"), minutes(2).alias("at"))
    return facts.advance_jobs(jobs, running.unionByName(done)).select("job_id", "status", F.col("started_at").isNotNull().alias("started"), F.col("finished_at").isNotNull().alias("finished"))


@query("state_upsert", "mem", f"""{STATES_SQL} SELECT preset_id, CASE WHEN preset_id IN ('preset-1', 'preset-2') THEN 'building' ELSE state END AS state FROM s UNION ALL SELECT DISTINCT 'new-' || preset_id, 'dirty' FROM mem""")
def _(v):
    rows = _states(v)
    none = F.lit(None).cast("string").alias("last_error")
    changes = rows.where("preset_id in ('preset-1', 'preset-2')").select("preset_id", F.lit("building").alias("state"), none)
    new = v.mem.select(F.concat(F.lit("new-"), "preset_id").alias("preset_id")).distinct().select("preset_id", F.lit("dirty").alias("state"), none)
    return index.upsert_states(rows, changes.unionByName(new)).select("preset_id", "state")


@query("migrate_embeddings", "mem", "SELECT memory_id, TRUE AS cleared FROM mem")
def _(v):
    out = facts.drop_legacy_vectors(v.mem.withColumn("embedding_model_id", F.lit("m0")))
    return out.select("memory_id", (F.col("embedding").isNull() & F.col("embedding_model_id").isNull()).alias("cleared"))


@query("extraction_trigger", "msglog", "SELECT conversation_id, seq AS up_to, CAST(12 AS BIGINT) AS messages, 'run' AS action FROM msglog WHERE seq % 12 = 0")
def _(v):
    from engramlake.streaming import trigger

    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    done = v.msglog.select("conversation_id", F.lit("message").alias("kind"), "seq", (2 * F.col("seq")).alias("order"))
    return trigger.runs(done.unionByName(done.where("seq % 12 = 0").withColumns({"kind": F.lit("done"), "order": F.col("order") + 1})), window=12).select("conversation_id", "up_to", "messages", "action")


@query("extraction_failures", "msglog", """f AS (SELECT conversation_id, CAST(1 AS BIGINT) AS from_seq, least(count(*), 13) AS up_to FROM msglog WHERE CAST(conversation_id AS BIGINT) % 3 = 0 GROUP BY 1 HAVING count(*) >= 12)
SELECT sha256(f.conversation_id || chr(0) || from_seq || chr(0) || up_to) AS job_id, f.conversation_id, 'extract' AS kind, 'failed' AS status, from_seq, up_to, up_to AS messages, string_agg(coalesce(content, ''), chr(10) ORDER BY seq) AS input, 'try 3' AS error
FROM f JOIN msglog m ON m.conversation_id = f.conversation_id AND m.seq BETWEEN from_seq AND up_to GROUP BY f.conversation_id, from_seq, up_to""")
def _(v):
    """In every third conversation the first run fails after messages 12, 13 and 14, each time over what waits by then: one job, and the cursor moves on."""
    from engramlake.streaming import trigger

    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    said = v.msglog.select("conversation_id", F.lit("message").alias("kind"), "seq", F.lit(None).cast("string").alias("error"), (2 * F.col("seq")).alias("order"))
    first = said.where("seq = 1 and cast(conversation_id as bigint) % 3 = 0")
    tries = first.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumns({"kind": F.lit("failed"), "error": F.concat(F.lit("try "), F.col("n").cast("string")), "order": F.col("n").cast("long") * 2 + 23}).drop("n")
    return trigger.failed_jobs(trigger.runs(said.unionByName(tries), window=12), v.msglog)


@query("latest_snapshot", "job", "SELECT preset_id, conversation_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY preset_id, conversation_id ORDER BY created_at DESC, job_id DESC) AS n FROM job) WHERE n = 1")
def _(v):
    return facts.latest(v.job, ["preset_id", "conversation_id"], F.col("created_at").desc(), F.col("job_id").desc()).select("preset_id", "conversation_id", "job_id")


@query("list_snapshots", "job", "SELECT job_id, (epoch_us(created_at) // 1000) AS created_ms FROM job WHERE conversation_id = '7' ORDER BY created_at DESC, job_id LIMIT 20")
def _(v):
    return browse.paginate(v.job.where("conversation_id = '7'"), [F.col("created_at").desc(), "job_id"]).select("job_id", ms("created_at").alias("created_ms"))


@query("migrate_webui", "mem", "SELECT memory_id, CASE WHEN memory_id % 5 = 1 THEN NULL ELSE source_conversation_id END AS source_conversation_id FROM mem")
def _(v):
    old = v.mem.withColumn("source_conversation_id", F.when(F.col("memory_id") % 5 == 1, F.concat(F.lit("webui:"), "source_conversation_id")).otherwise(F.col("source_conversation_id")))
    return facts.migrate_conversations(old).select("memory_id", "source_conversation_id")


@query("snapshot_text", "chat", f"""t AS (SELECT conversation_id, seq, CASE WHEN seq % 3 = 2 THEN ' ' WHEN length(content) % 50 <> 0 THEN {sql_trim('content')} END AS final_text FROM chat)
SELECT conversation_id AS snapshot_id, coalesce(string_agg(final_text, chr(10) ORDER BY seq) FILTER (WHERE trim(final_text) <> ''), '') AS body FROM t GROUP BY conversation_id HAVING count(final_text) = count(*)""")
def _(v):
    """A snapshot a conversation, an item a turn; some items are blank, some lack their text."""
    final = F.when(F.col("seq") % 3 == 2, " ").when(F.length("content") % 50 != 0, F.concat(F.lit(" "), "content", F.lit("\n")))
    items = v.chat.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct("seq", final.alias("final_text")))).alias("items"))
    return facts.migrate_snapshots(items).select(F.col("conversation_id").alias("snapshot_id"), facts.snapshot_text("items").alias("body"))


@query("memory_render", "mem", "SELECT memory_id, concat_ws(chr(10), 'id=' || memory_id, 'type=' || type, 'importance=' || importance, 'keywords=' || array_to_string(keywords, '、'), 'source=' || source_label, 'content:' || chr(10) || content) AS view FROM mem")
def _(v):
    return facts.render_memories(v.mem)


# ---- logs ----

SEGMENTS = """marked AS (SELECT *, CASE WHEN role = 'assistant' AND coalesce(lead(role) OVER w, '') <> 'assistant' THEN 1 ELSE 0 END AS closes FROM msglog WINDOW w AS (PARTITION BY conversation_id ORDER BY seq)),
numbered AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM marked),
segs AS (SELECT *, max(closes) OVER (PARTITION BY conversation_id, segment) = 0 AS open FROM numbered)"""
UNITS = f"""{SEGMENTS},
lens AS (SELECT conversation_id, segment, count(*) AS length, coalesce(max(seq) - max(CASE WHEN role <> 'assistant' THEN seq END) + 1, count(*)) AS exchange FROM segs WHERE NOT open GROUP BY 1, 2),
budget AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY conversation_id ORDER BY segment DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later, first_value(exchange) OVER (PARTITION BY conversation_id ORDER BY segment DESC) + 12 AS total FROM lens),
units AS (SELECT conversation_id, CAST(segment AS BIGINT) AS segment, length, CAST(least(length, greatest(greatest(0, least(total - later, length)), exchange)) AS BIGINT) AS keep FROM budget)"""


@query("segments", "msglog", f"{SEGMENTS} SELECT conversation_id, seq, CAST(segment AS BIGINT) AS segment, open FROM segs")
def _(v):
    return log.segments(v.msglog).select("conversation_id", "seq", F.col("segment").cast("long").alias("segment"), "open")


@query("trailing_exchange", "msglog", f"{SEGMENTS} SELECT conversation_id, CAST(segment AS BIGINT) AS segment, count(*) AS length, coalesce(max(seq) - max(CASE WHEN role <> 'assistant' THEN seq END) + 1, count(*)) AS exchange FROM segs GROUP BY 1, 2")
def _(v):
    return log.exchange_lengths(log.segments(v.msglog)).select("conversation_id", F.col("segment").cast("long").alias("segment"), "length", "exchange")


@query("anchored_units", "msglog", f"{UNITS} SELECT * FROM units")
def _(v):
    return log.anchored_units(log.segments(v.msglog), 12).withColumn("segment", F.col("segment").cast("long"))


@query("pack_chunks", "msglog", "RECURSIVE_PLACEHOLDER")
def _(v):
    units = log.anchored_units(log.segments(v.msglog), 12).select("conversation_id", F.col("segment").cast("long").alias("unit"), F.col("keep").alias("size"))
    return log.pack(units, 12)


SQL["pack_chunks"] = with_views("msglog", f"""{UNITS},
back AS (SELECT conversation_id, segment AS unit, keep AS size, row_number() OVER (PARTITION BY conversation_id ORDER BY segment DESC) AS n FROM units),
fold AS (SELECT conversation_id, unit, size, n, 0 AS chunk, size AS held FROM back WHERE n = 1
  UNION ALL SELECT b.conversation_id, b.unit, b.size, b.n, CASE WHEN f.held + b.size <= 18 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.held + b.size <= 18 THEN f.held + b.size ELSE b.size END FROM fold f JOIN back b ON b.conversation_id = f.conversation_id AND b.n = f.n + 1)
SELECT conversation_id, unit, size, CAST(chunk AS INTEGER) AS chunk FROM fold""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("plan_chunks", "msglog", None)
def _(v):
    return log.plan_chunks(v.msglog, 12)


SQL["plan_chunks"] = SQL["pack_chunks"].rsplit("SELECT conversation_id, unit", 1)[0] + """, placed AS (SELECT s.conversation_id, s.seq, s.segment, row_number() OVER (PARTITION BY s.conversation_id, s.segment ORDER BY s.seq DESC) AS place FROM segs s WHERE NOT s.open)
SELECT p.conversation_id, p.seq, CAST(f.chunk AS INTEGER) AS chunk FROM placed p JOIN fold f ON f.conversation_id = p.conversation_id AND f.unit = p.segment WHERE p.place <= f.size"""


@query("plan_chunks_overheard", "msglog", "SELECT conversation_id, count(*) AS kept, TRUE AS within FROM msglog GROUP BY conversation_id")
def _(v):
    sizes = log.plan_chunks(v.msglog, 12, overheard=True).groupBy("conversation_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("conversation_id").agg(F.sum("n").alias("kept"), (F.max("n") <= 18).alias("within"))


@query("recall_throttle", "msglog", None)
def _(v):
    return log.throttle(v.msglog, 10)


SQL["recall_throttle"] = with_views("msglog", """asks AS (SELECT conversation_id, seq, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS n FROM msglog WHERE role = 'user'),
fold AS (SELECT conversation_id, seq, n, TRUE AS runs, seq AS anchor FROM asks WHERE n = 1
  UNION ALL SELECT a.conversation_id, a.seq, a.n, a.seq - f.anchor >= 10, CASE WHEN a.seq - f.anchor >= 10 THEN a.seq ELSE f.anchor END FROM fold f JOIN asks a ON a.conversation_id = f.conversation_id AND a.n = f.n + 1)
SELECT conversation_id, seq, runs FROM fold""").replace("WITH ", "WITH RECURSIVE ", 1)


@query("recall_history", "msglog", """cur AS (SELECT conversation_id, max(seq) - 3 AS at FROM msglog GROUP BY 1)
SELECT conversation_id, seq FROM (SELECT m.conversation_id, m.seq, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.seq DESC) AS n FROM msglog m JOIN cur c USING (conversation_id) WHERE c.at < 1 OR m.seq < c.at) WHERE n <= 20""")
def _(v):
    at = v.msglog.groupBy("conversation_id").agg((F.max("seq") - 3).alias("at"))
    current = v.msglog.join(at, "conversation_id").where("seq = at").select("conversation_id", "message_id", "user_id", "timestamp", "content")
    return log.recall_history(v.msglog, current, 20).select("conversation_id", "seq")


@query("log_reads", "msglog", "SELECT conversation_id, max(seq) AS tail_seq, count(*) FILTER (WHERE seq > 5) AS after, least(count(*), 10) AS last FROM msglog GROUP BY conversation_id")
def _(v):
    after = log.after_seq(v.msglog, 5).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("after"))
    last = log.last_n(v.msglog, 10).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("last"))
    return log.tail_seq(v.msglog).join(after, "conversation_id", "left").join(last, "conversation_id", "left").select("conversation_id", "tail_seq", F.coalesce("after", F.lit(0)).alias("after"), F.coalesce("last", F.lit(0)).alias("last"))


@query("epoch_filter", "msglog", "e AS (SELECT conversation_id, max(ts) - 86400000 AS c FROM msglog GROUP BY 1) SELECT m.conversation_id, m.seq FROM msglog m JOIN e USING (conversation_id) WHERE m.ts > e.c")
def _(v):
    epochs = v.msglog.groupBy("conversation_id").agg((F.max("timestamp") - 86_400_000).alias("cleared"))
    return log.after_epoch(v.msglog.join(epochs, "conversation_id"), F.col("cleared"), F.lit(0)).select("conversation_id", "seq")


@query("backfill_merge", "msglog", """k AS (SELECT conversation_id, CASE WHEN message_id IS NOT NULL THEN 'id:' || message_id ELSE 'k:' || author || ':' || ts || ':' || content END AS message_key, ts, seq FROM msglog),
live AS (SELECT * FROM k WHERE seq > 10), rows AS (SELECT conversation_id, message_key, 1 AS part, ts FROM live UNION ALL SELECT conversation_id, message_key, 0, ts FROM k WHERE seq <= 14 AND NOT EXISTS (SELECT 1 FROM live l WHERE l.conversation_id = k.conversation_id AND l.message_key = k.message_key))
SELECT conversation_id, message_key, row_number() OVER (PARTITION BY conversation_id ORDER BY part, ts, message_key) AS seq FROM rows""")
def _(v):
    keyed = v.msglog.select("conversation_id", log.message_key("message_id", "user_id", "timestamp", "content").alias("message_key"), F.col("timestamp").alias("ts"), "seq")
    return log.backfill(keyed.where("seq > 10"), keyed.where("seq <= 14")).select("conversation_id", "message_key", F.col("seq").cast("long").alias("seq"))


@query("bot_run", "msglog", """f AS (SELECT conversation_id, max(seq) // 2 AS at FROM msglog GROUP BY 1), r AS (SELECT m.* FROM msglog m JOIN f USING (conversation_id) WHERE m.seq > f.at),
e AS (SELECT conversation_id, max(seq) AS stop FROM r WHERE role = 'assistant' GROUP BY 1), b AS (SELECT r.conversation_id, max(CASE WHEN r.role <> 'assistant' THEN r.seq END) AS start FROM r JOIN e USING (conversation_id) WHERE r.seq <= e.stop GROUP BY 1)
SELECT r.conversation_id, r.seq FROM r JOIN e USING (conversation_id) JOIN b USING (conversation_id) WHERE r.seq <= e.stop AND r.seq > coalesce(b.start, -1)""")
def _(v):
    focus = v.msglog.groupBy("conversation_id").agg(F.expr("max(seq) div 2").alias("focus_seq"))
    return log.bot_run(v.msglog, focus).select("conversation_id", "seq")


@query("ingest_filter", "msglog", f"SELECT conversation_id, seq, author AS user_id, coalesce({sql_trim('name')}, author) AS name FROM msglog WHERE author <> 'u3' AND seq % 11 <> 0")
def _(v):
    return log.ingest(v.msglog.withColumn("is_command", F.col("seq") % 11 == 0), "u3").select("conversation_id", "seq", "user_id", "name")


@query("log_transcript", "msglog", f"SELECT conversation_id, seq, CASE WHEN role <> 'assistant' THEN sha256('qq' || chr(0) || author) END AS speaker_key, CASE WHEN role = 'assistant' THEN 'Bot' ELSE {sql_trim('name')} END AS speaker_label FROM msglog WHERE role = 'assistant' OR name IS NOT NULL")
def _(v):
    return log.transcript(v.msglog, "qq", "Bot").select("conversation_id", "seq", "speaker_key", "speaker_label")


@query("payload_speakers", "msglog", f"SELECT conversation_id, {sql_trim('name')} AS name, arg_max(author, seq) AS speaker_key FROM msglog WHERE name IS NOT NULL AND role = 'user' GROUP BY 1, 2")
def _(v):
    rows = v.msglog.where("name is not null and role = 'user'").select("conversation_id", text.trim("name").alias("name"), F.col("user_id").alias("speaker_key"), "seq")
    return registry.payload_speakers(rows)


@query("ordered_distinct", "msglog", "first AS (SELECT conversation_id, author, min(seq) AS s FROM msglog WHERE role = 'user' GROUP BY 1, 2) SELECT conversation_id, string_agg(author, ',' ORDER BY s) AS speaker_keys FROM first GROUP BY conversation_id")
def _(v):
    return registry.speakers_of_window(v.msglog.withColumn("speaker_key", F.col("user_id"))).withColumn("speaker_keys", F.array_join("speaker_keys", ","))


@query("whitelist", "msglog", "SELECT conversation_id, seq FROM msglog WHERE CASE WHEN seq % 2 = 0 THEN author IN ('u1', 'u2') ELSE room IN ('c3', 'c4') END")
def _(v):
    return v.msglog.withColumn("direct", F.col("seq") % 2 == 0).where(log.allowed("direct", "user_id", "room", ["u1", "u2"], ["c3", "c4"])).select("conversation_id", "seq")


@query("origin_label", "msglog", "SELECT conversation_id, seq, CASE WHEN seq % 2 = 0 THEN '来源于与' || name || '（用户 ID：' || author || '）的私聊' ELSE '来源于「' || name || '」（群聊 ID：' || room || '）的群聊' END AS source_label FROM msglog")
def _(v):
    return v.msglog.withColumn("direct", F.col("seq") % 2 == 0).select("conversation_id", "seq", log.origin_label("direct", "name", "user_id", "name", "room").alias("source_label"))


@query("conv_key", "msglog", f"SELECT conversation_id, seq, CASE WHEN seq % 2 = 0 THEN 'private:' || {sql_trim('name')} ELSE 'group:' || room END AS conv_key FROM msglog")
def _(v):
    return v.msglog.withColumn("direct", F.col("seq") % 2 == 0).select("conversation_id", "seq", text.conversation_key("direct", "name", "room").alias("conv_key"))


@query("transcript_render", "msglog", "SELECT conversation_id, seq, '[' || strftime(epoch_ms(ts), '%Y-%m-%d %H:%M') || '] ' || author || '：' || content AS line FROM msglog WHERE trim(content) = content AND NOT regexp_matches(content, '[\\r\\n]')")
def _(v):
    rows = v.msglog.where((text.trim("content") == F.col("content")) & ~F.col("content").rlike(r"[\r\n]"))
    return rows.select("conversation_id", "seq", F.array_join(text.transcript_lines(F.timestamp_millis("timestamp"), "user_id", text.content_lines("content")), "\n").alias("line"))


@query("transcript_reason", "msglog", "SELECT conversation_id, seq, CASE WHEN seq % 5 = 0 THEN 'missing-created-at' WHEN name IS NULL THEN 'missing-speaker' WHEN seq % 7 = 0 THEN 'empty-content' END AS reason FROM msglog")
def _(v):
    rows = v.msglog.withColumn("at", F.when(F.col("seq") % 5 != 0, F.col("timestamp"))).withColumn("lines", F.when(F.col("seq") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("content")))
    return rows.select("conversation_id", "seq", text.transcript_reason("at", "name", F.col("lines")).alias("reason"))


@query("chat_turns", "chat", "SELECT role, count(*) AS turns, count(DISTINCT conversation_id) AS conversations FROM chat WHERE role <> 'system' GROUP BY role")
def _(v):
    return v.chat.where("role <> 'system'").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conversation_id").alias("conversations"))


# ---- text functions ----

@query("speaker_line", "chat", f"""l AS (SELECT *, length(content) % 5 AS k, string_split(content, chr(10))[1] AS line FROM chat)
SELECT conversation_id, seq, CASE k WHEN 0 THEN role WHEN 1 THEN role WHEN 2 THEN 'b' END AS speaker, CASE WHEN k < 3 THEN {sql_trim('line')} END AS content FROM l""")
def _(v):
    """Bracketed, bare and listed speakers, a name with a blank, and lines of no speaker."""
    kind, line = F.length("content") % 5, F.split("content", "\n")[0]
    spoken = (
        F.when(kind == 0, F.concat(F.lit("[1, "), "role", F.lit("] 说："), line)).when(kind == 1, F.concat("role", F.lit("说: "), line, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("[a，b ,] 说："), line)).when(kind == 3, F.concat(F.lit("a b说："), line)).otherwise(line)
    )
    return v.chat.withColumn("s", text.speaker_line(spoken)).select("conversation_id", "seq", "s.speaker", "s.content")


@query("content_lines", "", f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> ''), '|') AS lines FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.array_join(text.content_lines("text"), "|").alias("lines"))


@query("xml_escape", "", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def _(v):
    return v.table("pages").select("page_id", text.xml_escape("html").alias("escaped"))


@query("parse_time", "", """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_ms(date_trunc('second', ts)) WHEN 4 THEN epoch_ms(CAST(CAST(ts AS DATE) AS TIMESTAMP)) END AS VARCHAR) AS ms FROM events""")
def _(v):
    """Milliseconds, ISO times, words, blanks and ISO dates."""
    k = F.col("event_id") % 5
    given = F.when(k == 0, F.concat(F.lit(" "), F.unix_millis("ts").cast("string"), F.lit(" "))).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 2, F.lit("soon")).when(k == 3, F.lit("  ")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return v.table("events").select("event_id", F.unix_millis(text.parse_time(given)).cast("string").alias("ms"))


@query("json_card", "chat", f"""SELECT conversation_id, seq, CASE WHEN seq % 5 = 4 THEN '[卡片消息]' ELSE CASE WHEN seq % 2 = 0 THEN '[卡片:' || role || ']' ELSE '[卡片消息]' END || coalesce(' ' || nullif(CASE WHEN seq % 3 = 0 THEN role ELSE {sql_trim('content')} END, ''), '')
 || CASE WHEN seq % 5 < 3 THEN '（分享者：c' || conversation_id || '）' ELSE '' END END AS card FROM chat""")
def _(v):
    """Cards with and without source, prompt and sharer; every fifth is damaged."""
    n, none = F.col("seq"), F.lit(None).cast("string")
    detail = F.struct(F.when(n % 2 == 0, F.col("role")).otherwise(none).alias("title"), F.when(n % 5 < 3, F.struct(F.concat(F.lit(" c"), "conversation_id").alias("nick"))).alias("host"))
    whole = F.to_json(F.struct(F.when(n % 3 != 0, F.concat(F.lit(" "), "content")).otherwise(none).alias("prompt"), F.col("role").alias("desc"), F.struct(detail.alias("detail_1")).alias("meta")))
    return v.chat.select("conversation_id", "seq", text.json_card(F.when(n % 5 == 4, "{broken").otherwise(whole)).alias("card"))


@query("labels", "mem", "SELECT memory_id, 'user:' || substr(sha256(preset_id), 1, 8) AS synthetic, preset_id AS assistant FROM mem")
def _(v):
    return v.mem.select("memory_id", text.synthetic_label(text.sha256("preset_id")).alias("synthetic"), text.assistant_label(F.concat("preset_id", F.lit(" (role)")), " (role)").alias("assistant"))


@query("persona_prune", "", f"""l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN list_filter(a, lambda x, i: i % 3 <> 2) WHEN 1 THEN [] ELSE a END AS kept FROM l), c AS (SELECT *, array_to_string(kept, chr(10)) AS card0, len(a) AS n, len(a) - len(kept) AS gone FROM k),
b AS (SELECT *, gone > 0 AND (CAST(gone AS DOUBLE) / n > CAST(0.8 AS DOUBLE) OR length({sql_trim('card0')}) < 20) AS back FROM c)
SELECT doc_id, CASE WHEN gone = 0 OR back THEN text ELSE card0 END AS card, CAST(n AS INTEGER) AS total_lines, CAST(CASE WHEN back THEN 0 ELSE gone END AS INTEGER) AS deleted_lines, back AS used_raw_fallback FROM b""")
def _(v):
    """Every third line goes, or all, or a number that no line has."""
    count = F.size(F.split("text", "\n"))
    every = F.sequence(F.lit(0), count - 1)
    gone = F.when(F.col("doc_id") % 3 == 0, F.filter(every, lambda i: i % 3 == 1)).when(F.col("doc_id") % 3 == 1, every).otherwise(F.array(count))
    docs = v.table("documents").where("text is not null").withColumn("gone", gone)
    return docs.select("doc_id", text.prune_lines("text", "gone", 0.8, 20).alias("p")).select("doc_id", "p.*")


@query("line_edit", "", f"""l AS (SELECT doc_id, source, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {sql_trim('x')}), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_concat(CASE WHEN doc_id % 2 = 0 THEN list_concat(list_transform(a[1:1], lambda x: 'B'), a[3:]) ELSE a END, ['new ' || coalesce(source, '')]), '|') AS lines FROM l""")
def _(v):
    """The first line is replaced and the second deleted in every other text; one line is added."""
    changes = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit(0), F.lit("B"), F.lit(1), F.lit(None).cast("string"))).otherwise(F.create_map().cast("map<int,string>"))
    docs = v.table("documents").where("text is not null").select("doc_id", text.content_lines("text").alias("lines"), changes.alias("changes"), F.array(F.concat(F.lit("new "), F.coalesce("source", F.lit("")))).alias("additions"))
    return docs.select("doc_id", F.array_join(text.edit_lines("lines", "changes", "additions"), "|").alias("lines"))


@query("json_repair", "mem", "SELECT memory_id, CASE WHEN memory_id % 4 < 2 THEN array_to_string(keywords, ',') END AS items FROM mem")
def _(v):
    """The list itself, the list as a string, a string that is no list, a damaged document."""
    k = F.col("memory_id") % 4
    document = F.when(k == 0, F.to_json(F.struct(F.col("keywords").alias("m")))).when(k == 1, F.to_json(F.struct(F.to_json("keywords").alias("m")))).when(k == 2, '{"m":"no list"}').otherwise("{broken")
    return v.mem.select("memory_id", F.array_join(text.repaired_array(document, "m"), ",").alias("items"))


@query("valid_extracted", "mem", "SELECT memory_id, summary IS NOT NULL AND trim(summary) <> '' AND importance IS NOT NULL AND len(keywords) BETWEEN 1 AND 12 AS valid FROM mem")
def _(v):
    return v.mem.select("memory_id", text.valid_extracted(F.struct("type", "content", "summary", "sentiment", "keywords", "importance")).alias("valid"))


@query("source_messages", "chat", f"SELECT conversation_id, string_agg(CASE WHEN role = 'user' THEN 'Ann：' || {sql_trim('content')} ELSE {sql_trim('content')} END, chr(10) ORDER BY seq) AS rendered FROM chat WHERE role <> 'system' AND {sql_trim('content')} <> '' GROUP BY conversation_id")
def _(v):
    rows = v.chat.where("role <> 'system'").where(text.trim("content") != "")
    line = F.concat(F.when(F.col("role") == "user", "Ann：").otherwise(""), text.trim("content"))
    return rows.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("rendered"))


@query("latency_summary", "", "SELECT event_type, min(value) AS least, max(value) AS most, percentile_disc(0.5 ORDER BY value) AS p50, percentile_disc(0.95 ORDER BY value) AS p95 FROM (SELECT event_type, value FROM events WHERE value IS NOT NULL) GROUP BY event_type".replace("percentile_disc(0.5 ORDER BY value)", "quantile_disc(value, 0.5)").replace("percentile_disc(0.95 ORDER BY value)", "quantile_disc(value, 0.95)"))
def _(v):
    return v.table("events").where("value is not null").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.expr("percentile_disc(0.5) within group (order by value)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


# ---- groups ----

GRAPH = """pairs AS (SELECT a.preset_id, a.memory_id, b.memory_id AS neighbour, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM mem a JOIN mem b ON a.preset_id = b.preset_id AND a.memory_id <> b.memory_id WHERE a.status = 'active' AND b.status = 'active'),
graph AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY preset_id, memory_id ORDER BY score DESC, neighbour) AS rank FROM pairs) WHERE rank <= 10),
edges AS (SELECT preset_id, least(memory_id, neighbour) AS a, greatest(memory_id, neighbour) AS b, max(greatest(CAST(0 AS DOUBLE), score)) AS weight FROM graph GROUP BY 1, 2, 3 HAVING max(score) > 0)"""


@query("knn_graph", "mem", f"{GRAPH} SELECT * FROM graph")
def _(v):
    return cluster.knn_graph(v.mem)


@query("near_graph_recall", "mem", "SELECT preset_id, count(*) * 10 AS links, TRUE AS enough FROM mem WHERE status = 'active' GROUP BY preset_id")
def _(v):
    """Of the exact links, at least nine tenths must be found by cells.  These vectors are uniform, so it takes most of the cells; measured at sf0.1: 0.74 by 6 of 12, 0.91 by 9."""
    keys = ["preset_id", "memory_id", "neighbour"]
    found = cluster.near_graph(v.mem, cells=12, probes=10).select(*keys, F.lit(1).alias("_hit"))
    both = cluster.knn_graph(v.mem).select(*keys).join(found, keys, "left")
    return both.groupBy("preset_id").agg(F.count(F.lit(1)).alias("links"), (F.count("_hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query("graph_edges", "mem", f"{GRAPH} SELECT * FROM edges")
def _(v):
    return cluster.edges(cluster.knn_graph(v.mem))


def _labels(v):
    return v.mem.where("status = 'active'").select("preset_id", "memory_id", F.concat(F.lit("1-"), (F.expr("memory_id div 4") % 5).cast("string")).alias("label"))


@query("graph_objective", "mem", f"{GRAPH} SELECT preset_id, round(sum(CASE WHEN (a // 4) % 5 = (b // 4) % 5 THEN weight ELSE 0 END), 4) AS objective FROM edges GROUP BY preset_id")
def _(v):
    return cluster.objective(cluster.edges(cluster.knn_graph(v.mem)), _labels(v))


@query("plan_validate", "mem", "s AS (SELECT preset_id, (memory_id // 4) % 5 AS l, count(*) AS n FROM mem WHERE status = 'active' GROUP BY 1, 2) SELECT preset_id, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members, max(n) AS largest, min(n) AS smallest, max(n) <= 30 AND count(*) >= ceil(sum(n) / 30) AS valid FROM s GROUP BY preset_id")
def _(v):
    return cluster.validate(_labels(v))


@query("dream_eligible", "mem", "SELECT preset_id, count(*) AS active FROM mem WHERE status = 'active' GROUP BY preset_id HAVING count(*) >= 30")
def _(v):
    return cluster.eligible(v.mem)


@query("dream_coverage", "mem", "SELECT preset_id, count(*) AS target, count(*) FILTER (WHERE memory_id % 3 = 0 OR preset_id = 'preset-2') AS processed, count(*) FILTER (WHERE memory_id % 3 <> 0 AND preset_id <> 'preset-2') AS unprocessed, CASE WHEN preset_id = 'preset-2' THEN 'completed' ELSE 'partial' END AS status FROM mem WHERE status = 'active' GROUP BY preset_id")
def _(v):
    targets = v.mem.where("status = 'active'").select("preset_id", "memory_id")
    return cluster.run_coverage(targets, targets.where("memory_id % 3 = 0 or preset_id = 'preset-2'").select("memory_id"))


@query("dream_status", "mem", """c AS (SELECT memory_id, memory_id % 7 = 0 AS error, memory_id % 5 = 0 AS full_run, memory_id % 4 AS target, least(memory_id % 4, memory_id % 3) AS processed FROM mem)
SELECT memory_id, CASE WHEN error OR (processed = 0 AND (full_run OR target > 0)) THEN 'failed' WHEN target > processed THEN 'partial' ELSE 'completed' END AS status FROM c""")
def _(v):
    i = F.col("memory_id")
    runs = v.mem.select("memory_id", (i % 7 == 0).alias("error"), (i % 5 == 0).alias("full"), (i % 4).alias("target"), F.least(i % 4, i % 3).alias("processed"))
    runs = runs.withColumn("unprocessed", F.col("target") - F.col("processed"))
    return runs.select("memory_id", cluster.run_status(F.col("error"), F.col("full")).alias("status"))


@query("dream_ops", "mem", "SELECT memory_id % 9 AS batch, count(*) FILTER (WHERE memory_id % 4 = 0) AS created, count(*) FILTER (WHERE memory_id % 4 = 1) AS updated, count(*) FILTER (WHERE memory_id % 4 = 2) AS merged, count(*) FILTER (WHERE memory_id % 4 = 3) AS split, CAST(sum(CASE memory_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END) AS BIGINT) AS archived FROM mem GROUP BY 1")
def _(v):
    k = F.col("memory_id") % 4
    ops = v.mem.select((F.col("memory_id") % 9).alias("batch"), F.when(k == 0, "create").when(k == 1, "update").when(k == 2, "merge").otherwise("split").alias("kind"), F.when(k == 2, F.array("memory_id", "memory_id")).otherwise(F.array("memory_id")).alias("sources"))
    return cluster.operation_counts(ops)


@query("seed_neighbors", "mem", """s AS (SELECT memory_id AS seed, preset_id, embedding AS vector FROM mem WHERE memory_id IN (9, 13, 18))
SELECT seed, memory_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cosine DESC, memory_id) AS n FROM (SELECT q.seed, m.memory_id, round(list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 6) AS cosine FROM mem m JOIN s q ON q.preset_id = m.preset_id WHERE m.status = 'active' AND m.memory_id NOT IN (9, 13, 18))) WHERE n <= 12""")
def _(v):
    seeds = v.mem.where("memory_id in (9, 13, 18)").select(F.col("memory_id").alias("seed"), "preset_id", F.col("embedding").alias("vector"))
    return cluster.seed_neighbours(v.mem, seeds, 12)


@query("post_extraction", "mem", """s AS (SELECT memory_id AS seed, preset_id, embedding AS vector FROM mem WHERE memory_id % 50 = 3 AND status = 'active'),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY cosine DESC, memory_id) AS place FROM (SELECT q.seed, m.memory_id, round(list_cosine_similarity(CAST(m.embedding AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), 6) AS cosine FROM mem m JOIN s q ON q.preset_id = m.preset_id WHERE m.status = 'active' AND m.memory_id % 50 <> 3)) WHERE place <= 12 AND cosine >= 0.2),
b AS (SELECT DISTINCT seed, seed AS memory_id, 0 AS place FROM hit UNION ALL SELECT seed, memory_id, place FROM hit),
live AS (SELECT * FROM b WHERE memory_id % 10 <> 7 AND memory_id % 150 <> 103)
SELECT seed, memory_id, place FROM live WHERE seed IN (SELECT seed FROM live GROUP BY seed HAVING count(*) > 1 AND bool_or(memory_id = seed))""")
def _(v):
    """Every fiftieth memory is new; before the batches are worked on, some members and some seeds are archived."""
    seeds = v.mem.where("memory_id % 50 = 3").select(F.col("memory_id").alias("seed"), "preset_id", F.col("embedding").alias("vector"))
    batches, _left = cluster.post_extraction_batches(v.mem, seeds, 12, 0.2)
    since = v.mem.withColumn("status", F.when(F.expr("memory_id % 10 = 7 or memory_id % 150 = 103"), "archived").otherwise(F.col("status")))
    return cluster.refreshed_batches(batches, since)


@query("graph_refresh", "mem", f"""now AS (SELECT memory_id, preset_id, CASE WHEN memory_id % 40 = 6 THEN 'archived' ELSE status END AS status, CASE WHEN memory_id % 20 = 3 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM mem),
{GRAPH.replace('FROM mem a JOIN mem b', 'FROM now a JOIN now b')} SELECT * FROM graph""")
def _(v):
    """Since the graph was computed, one row in twenty came, one changed its text and vector, one in forty was archived."""
    taken = index.build(v.mem, v.mem.select("memory_id", "embedding"), 64)
    changed = F.expr("memory_id % 20 = 3")
    now_ = taken.withColumns({
        "content_hash": F.when(changed, F.lit("other")).otherwise(F.col("content_hash")), "embedding": F.when(changed, F.reverse("embedding")).otherwise(F.col("embedding")),
        "status": F.when(F.expr("memory_id % 40 = 6"), "archived").otherwise(F.col("status")),
    })
    before = taken.where("memory_id % 20 <> 11")
    return cluster.refreshed_graph(cluster.knn_graph(before), before.where("status = 'active'"), now_)


@query("dream_bisect")
def _(v):
    return cluster.groups(v.vectors)


@query("dream_refine")
def _(v):
    return cluster.refined(cluster.groups(v.vectors), cluster.edges(cluster.knn_graph(v.vectors)))


@query("dream_clusters", "mem", "SELECT preset_id, CAST(ceil(count(*) / 30) AS BIGINT) AS groups, count(*) AS members, TRUE AS valid FROM mem WHERE status = 'active' GROUP BY preset_id")
def _(v):
    plan = cluster.refined(cluster.groups(v.vectors), cluster.edges(cluster.knn_graph(v.vectors)))
    return cluster.validate(plan).select("preset_id", "groups", "members", "valid")


@query("dream_large", "mem", "SELECT preset_id, CAST(ceil(count(*) / 30) AS BIGINT) AS groups, count(*) AS members, TRUE AS valid, TRUE AS risen FROM mem WHERE status = 'active' GROUP BY preset_id")
def _(v):
    """Presets larger than one task may hold (here 64 rows): cut by exact ranks, then traded over all their edges; the objective rises over that of the cuts."""
    kept = Kept(v.spark)
    edges = kept.table(cluster.edges(cluster.knn_graph(v.vectors)))
    cut = kept.table(cluster.groups(v.vectors, single=64))
    plan = cluster.refined(cut, edges, most=2)
    worth = lambda labels, name: cluster.objective(edges, labels).withColumnRenamed("objective", name)
    both = worth(cut, "_before").join(worth(plan, "_after"), "preset_id").select("preset_id", (F.col("_after") > F.col("_before")).alias("risen"))
    return kept.result(cluster.validate(plan).join(both, "preset_id").select("preset_id", "groups", "members", "valid", "risen"), "dream-large")


@query("log_stream", "msglog", "k AS (SELECT conversation_id, CASE WHEN message_id IS NOT NULL THEN 'id:' || message_id ELSE 'k:' || author || ':' || ts || ':' || content END AS message_key, ts, seq FROM msglog) SELECT conversation_id, message_key, ts, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS seq FROM k")
def _(v):
    from engramlake.streaming import log_stream

    rows = v.msglog.select("conversation_id", log.message_key("message_id", "user_id", "timestamp", "content").alias("message_key"), F.col("timestamp").alias("ts"), "role", F.col("seq").alias("order"))
    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return log_stream.numbered(rows).select("conversation_id", "message_key", "ts", "seq")


@query("backfill_stream", "msglog", """k AS (SELECT conversation_id, CASE WHEN message_id IS NOT NULL THEN 'id:' || message_id ELSE 'k:' || author || ':' || ts || ':' || content END AS message_key, ts, seq FROM msglog),
b AS (SELECT conversation_id, count(*) AS n, count(*) // 2 AS h, count(*) // 2 + (count(*) - count(*) // 2) // 2 AS m FROM k GROUP BY 1),
p AS (SELECT k.*, n, CASE WHEN seq > h THEN seq ELSE row_number() OVER (PARTITION BY conversation_id, seq > h ORDER BY ts, message_key) END AS num FROM k JOIN b USING (conversation_id))
SELECT conversation_id, 'message' AS kind, message_key, ts, num AS seq FROM p
UNION ALL SELECT conversation_id, 'message', message_key, ts, n + 1 FROM p WHERE seq = 1 AND n - num >= 20
UNION ALL SELECT conversation_id, 'cursor', 'early', NULL, CASE WHEN h + 2 <= m THEN greatest(h + 2, m - 20) ELSE least(n, h + 2) END FROM b
UNION ALL SELECT conversation_id, 'cursor', 'late', NULL, n FROM b
UNION ALL SELECT conversation_id, 'fetch', NULL, NULL, NULL FROM b UNION ALL SELECT conversation_id, 'fetch', NULL, NULL, NULL FROM b WHERE m > h""")
def _(v):
    """A log of 20 keys.  The older half is history, with four messages that are live as well; its first fetch fails, the second ends when half of the live messages have come.  At the end the oldest message comes again."""
    from engramlake.streaming import backfill

    v.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    every = Window.partitionBy("conversation_id")
    rows = v.msglog.select("conversation_id", log.message_key("message_id", "user_id", "timestamp", "content").alias("message_key"), F.col("timestamp").alias("ts"), "role", "seq", F.count(F.lit(1)).over(every).alias("n"))
    rows = rows.withColumn("h", F.expr("n div 2")).withColumn("m", F.expr("h + (n - h) div 2"))

    def sent(some, kind, order, **new):
        new = {"kind": F.lit(kind), "order": F.expr(order).cast("long"), **new}
        return some.withColumns(new).select("conversation_id", "kind", "message_key", "ts", "role", "order")

    one, bare = rows.where("seq = 1"), {"message_key": F.lit(None).cast("string"), "ts": F.lit(None).cast("long")}
    live = [sent(rows.where("seq > h"), "live", "10 * seq + 100"), sent(one, "live", "10 * n + 106"), sent(one, "open", "0", **bare)]
    live += [sent(one, "cursor", order, **{**bare, "message_key": F.lit(name)}) for name, order in (("early", "10 * (h + 2) + 105"), ("late", "10 * n + 105"))]
    past = [sent(rows.where("seq <= 3"), "history", "1"), sent(one, "failed", "2", **bare), sent(rows.where("seq <= h + least(4, m - h)"), "history", "10 * m + 101"), sent(one, "fetched", "10 * m + 102", **bare)]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return backfill.backfilled(union(live), union(past), capacity=20).select("conversation_id", "kind", "message_key", "ts", "seq")


@query("element_text")
def _(v):
    from engramlake.functions import elements

    rows = v.table("conversations").select("conv_id", "turn", F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.struct(F.col("text").alias("content")).alias("attrs")))).alias("elements"))
    return rows.select("conv_id", "turn", elements.to_text("elements").alias("rendered"), elements.mentioned("elements").alias("mentioned"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(Views(spark, folder))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if sql}
