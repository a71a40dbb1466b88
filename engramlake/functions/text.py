"""Column functions: trimming, normalisation, hashing, parsing and rendering of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.schema import ENTRY_TYPES, MAX_KEYWORDS

#: White space of any kind: that of \s and of \p{Z}, and the byte order mark.
WHITE = "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANKS = r"[\s\p{Z}﻿]+"
NUL = "\u0000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(col(c), F.lit(WHITE))  # looks at both ends only, a pattern at every character


def or_null(c) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def collapse(c) -> Column:
    return trim(F.regexp_replace(col(c), BLANKS, " "))


def alias_key(c) -> Column:
    return F.lower(collapse(c))


def _clean(items: Column, each) -> Column:
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), each), lambda x: x != "")


def keywords(c) -> Column:
    """Stored keywords: trimmed, case-sensitive first occurrences, 12 at most."""
    return F.slice(F.array_distinct(_clean(col(c), trim)), 1, MAX_KEYWORDS)


def index_keywords(c) -> Column:
    """Indexed keywords: trimmed, lower case, distinct, no limit."""
    return F.array_distinct(_clean(col(c), lambda x: F.lower(trim(x))))


def speaker_keys(c) -> Column:
    return F.array_sort(F.array_distinct(_clean(col(c), trim)))


def aliases(c, label=None) -> Column:
    """Distinct by folded form, first spelling kept; the label alone where there are none."""
    given = col(c) if label is None else F.coalesce(col(c), F.array(col(label)))
    own = _clean(given, trim)
    folded = F.transform(own, alias_key)
    return F.filter(own, lambda x, i: F.array_position(folded, alias_key(x)) == i + 1)


def importance(c) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(c))))


def sha256(c) -> Column:
    return F.sha2(col(c), 256)


def content_hash(c) -> Column:
    return sha256(col(c))


def keywords_hash(c) -> Column:
    """Hash of the sorted indexed keywords as a JSON array."""
    return sha256(F.to_json(F.array_sort(index_keywords(c))))


def derived_id(*parts) -> Column:
    return sha256(F.concat_ws(NUL, *[col(p) for p in parts]))


def speaker_key(platform, user_id) -> Column:
    return derived_id(trim(platform), trim(user_id))


def synthetic_label(key) -> Column:
    return F.concat(F.lit("user:"), F.substring(col(key), 1, 8))


def scope_speaker_keys(platform, speaker_id, user_id) -> Column:
    who, where = or_null(F.coalesce(col(speaker_id), col(user_id))), or_null(platform)
    return F.when(who.isNotNull() & where.isNotNull(), F.array(speaker_key(where, who))).otherwise(F.array().cast("array<string>"))


def conversation_key(is_direct, user_id, guild_id) -> Column:
    who = or_null(F.when(col(is_direct), col(user_id)).otherwise(col(guild_id)))
    return F.when(who.isNotNull(), F.concat(F.when(col(is_direct), "private:").otherwise("group:"), who))


def assistant_label(preset_id, suffix: str) -> Column:
    p = col(preset_id)
    return F.when(p.endswith(suffix), F.substring(p, F.lit(1), F.length(p) - len(suffix))).otherwise(p)


# The text format of a spoken line, bracketed or bare, which stored transcripts follow.
BRACKETED = r"^\[([^\]]+)\]\s*说\s*[:：]\s*(.*)$"
BARE = r"^([^\s:：\[\]，。！？,.!?]{1,64})\s*说\s*[:：]\s*(.*)$"


def speaker_line(line) -> Column:
    """struct(speaker, content) of a line like "name说：text", also in brackets; null if it is none."""
    x = col(line)
    names = _clean(F.split(F.regexp_extract(x, BRACKETED, 1), "[,，]"), trim)
    bracket = F.struct(F.coalesce(F.try_element_at(names, F.lit(-1)), trim(F.regexp_extract(x, BRACKETED, 1))).alias("speaker"), trim(F.regexp_extract(x, BRACKETED, 2)).alias("content"))
    bare = F.struct(trim(F.regexp_extract(x, BARE, 1)).alias("speaker"), trim(F.regexp_extract(x, BARE, 2)).alias("content"))
    return F.when(x.rlike(BRACKETED), bracket).when(x.rlike(BARE), bare)


def content_lines(c) -> Column:
    return _clean(F.split(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), "\n"), trim)


def parse_time(c) -> Column:
    """Milliseconds or ISO text to a timestamp, null where it is neither."""
    x = trim(c)
    return F.when(x == "", None).when(x.rlike(r"^\d+$"), F.timestamp_millis(F.try_to_number(x, F.lit("9" * 18)).cast("bigint"))).otherwise(F.try_to_timestamp(x))


def transcript_reason(created_at, label, lines) -> Column:
    """Why a message makes no transcript line; null if it does."""
    return F.when(col(created_at).isNull(), "missing-created-at").when(or_null(label).isNull(), "missing-speaker").when(F.size(lines) <= 0, "empty-content")


def transcript_lines(time, label, lines) -> Column:
    head = F.concat(F.lit("["), F.date_format(col(time), "yyyy-MM-dd HH:mm"), F.lit("] "), col(label), F.lit("："))
    return F.transform(lines, lambda x, i: F.when(i == 0, F.concat(head, x)).otherwise(x))


def xml_escape(c) -> Column:
    x = F.replace(col(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def json_card(payload, app_name=None) -> Column:
    """One line for a card message: source, prompt and sharer where the payload has them."""
    p = col(payload)
    field = lambda path: or_null(F.get_json_object(p, path))
    source = F.coalesce(field("$.meta.detail_1.title"), col(app_name) if app_name is not None else F.lit(None).cast("string"))
    prompt, sharer = F.coalesce(field("$.prompt"), field("$.desc")), field("$.meta.detail_1.host.nick")
    return F.concat(
        F.when(source.isNull(), "[卡片消息]").otherwise(F.concat(F.lit("[卡片:"), source, F.lit("]"))),
        F.coalesce(F.concat(F.lit(" "), prompt), F.lit("")),
        F.coalesce(F.concat(F.lit("（分享者："), sharer, F.lit("）")), F.lit("")),
    )


def prune_lines(raw, deleted, max_ratio: float, min_chars: int) -> Column:
    """struct(card, total_lines, deleted_lines, used_raw_fallback): raw without numbered lines, or raw if too much would go."""
    lines = F.split(col(raw), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(col(deleted), i))
    card, gone = F.array_join(kept, "\n"), F.size(lines) - F.size(kept)
    back = (gone > 0) & ((gone / F.size(lines) > max_ratio) | (F.length(trim(card)) < min_chars))
    return F.struct(
        F.when((gone == 0) | back, col(raw)).otherwise(card).alias("card"), F.size(lines).alias("total_lines"),
        F.when(back, 0).otherwise(gone).alias("deleted_lines"), back.alias("used_raw_fallback"),
    )


def edit_lines(lines, changes, additions) -> Column:
    """lines with changes (map line number -> text, null deletes) on the old numbering, then additions."""
    # a change is present when the map holds its key, even with a null value
    kept = F.filter(F.transform(col(lines), lambda x, i: F.struct(F.map_contains_key(col(changes), i).alias("c"), F.try_element_at(col(changes), i).alias("t"), x.alias("x"))), lambda s: ~s["c"] | s["t"].isNotNull())
    return F.concat(F.transform(kept, lambda s: F.when(s["c"], s["t"]).otherwise(s["x"])), col(additions))


def repaired_array(document, field: str) -> Column:
    """A JSON object's array field, also where the array was given as a string; null if it is none."""
    value = F.get_json_object(col(document), f"$.{field}")
    return F.when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>"))


def valid_extracted(m) -> Column:
    """Whether a generated record is complete: known type, texts, 1 to 12 keywords, importance in 0..1."""
    f = lambda n: col(m)[n]
    filled = [or_null(f(n)).isNotNull() for n in ("content", "summary", "sentiment")]
    words = F.size(f("keywords")).between(1, MAX_KEYWORDS) & F.forall(f("keywords"), lambda k: trim(k) != "")
    return F.coalesce(reduce(lambda a, b: a & b, filled) & f("type").isin(*ENTRY_TYPES) & words & f("importance").between(0, 1) & ~F.isnan(f("importance")), F.lit(False))
