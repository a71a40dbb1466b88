"""Rich chat messages (a JSON tree of elements) as plain text.

Trees nest without bound, which no column type does, so this is an Arrow-batched
function: one call for a batch of rows.  Invalid JSON reads as no elements.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from engramlake.functions.text import col

# Element kinds and their placeholders.
INLINE = frozenset("template p b strong i em u ins s del code pre spl a".split())
PLAIN = {
    "br": "\n", "img": "[图片]", "image": "[图片]", "audio": "[语音]", "video": "[视频]", "xml": "[卡片消息]",
    "contact": "[联系人]", "dice": "[骰子]", "rps": "[猜拳]",
}
NAMED = {
    "face": ("表情", ("name",)), "emoji": ("表情", ("name",)), "file": ("文件", ("name", "title", "file_name")), "share": ("分享", ("title",)),
    "location": ("位置", ("title",)), "mface": ("表情包", ("name",)),
}
FORWARDED = frozenset(("forward", "milky:forward"))
UNKNOWN, EVERYONE, HISTORY, CARD = "[非文本消息]", "@全体成员", "聊天记录", "卡片"
AUTHORS = frozenset(("user", "member", "channel"))


def _attr(element: dict, *names: str) -> str | None:
    attrs = element.get("attrs") or {}
    for n in names:
        if isinstance(v := attrs.get(n), str) and v.strip():
            return v.strip()
    return None


def _children(element: dict) -> list:
    return [c for c in element.get("children") or [] if isinstance(c, dict)]


def _labelled(label: str, name: str | None) -> str:
    return f"[{label}:{name}]" if name else f"[{label}]"


def _card(payload: str | None, source: str | None) -> str:
    try:
        data = json.loads(payload or "{}")
    except ValueError:
        data = {}
    data = data if isinstance(data, dict) else {}
    detail = ((data.get("meta") or {}) if isinstance(data.get("meta"), dict) else {}).get("detail_1") or {}
    detail = {"attrs": detail if isinstance(detail, dict) else {}}
    host = {"attrs": detail["attrs"].get("host") if isinstance(detail["attrs"].get("host"), dict) else {}}
    source = _attr(detail, "title") or source
    prompt, sharer = _attr({"attrs": data}, "prompt", "desc"), _attr(host, "nick")
    return (f"[{CARD}:{source}]" if source else f"[{CARD}消息]") + (f" {prompt}" if prompt else "") + (f"（分享者：{sharer}）" if sharer else "")


def _one(e: dict, names: dict) -> str:
    kind = e.get("type")
    if kind in INLINE:
        inner = [_one(c, names) for c in _children(e)]
        if not inner:
            link = _attr(e, "href") if kind == "a" else None
            return f"[链接:{link}]" if link else ""
        return "".join(inner) + ("\n" if kind == "p" else "")
    if kind == "text":
        content = (e.get("attrs") or {}).get("content")
        return content if isinstance(content, str) else ""
    if kind == "at":
        if (e.get("attrs") or {}).get("type") == "all":
            return EVERYONE
        who = _attr(e, "id")
        return f"@{names.get(who, who)}" if who else UNKNOWN
    if kind == "sharp":
        channel = _attr(e, "name", "id")
        return f"#{channel}" if channel else "[频道]"
    if kind in PLAIN:
        return PLAIN[kind]
    if kind in NAMED:
        label, keys = NAMED[kind]
        return _labelled(label, _attr(e, *keys))
    if kind in FORWARDED or kind == "message" and str((e.get("attrs") or {}).get("forward")).lower() in ("true", "1"):
        return _labelled(HISTORY, " ".join(x for x in (_attr(e, "title"), _attr(e, "summary")) if x))
    if kind == "json":
        return _card(_attr(e, "data"), None)
    if kind == "milky:light-app":
        return _card(_attr(e, "jsonPayload"), _attr(e, "appName"))
    if kind == "quote":
        author = next((_attr(c, "name", "id") for c in _children(e) if c.get("type") == "user"), None)
        body = render([c for c in _children(e) if c.get("type") not in AUTHORS], names)
        return f'[回复 "{"：".join(x for x in (author, body) if x)}"] '
    return UNKNOWN


def render(elements: list, names: dict | None = None) -> str:
    return "".join(_one(e, names or {}) for e in elements if isinstance(e, dict)).strip()


def targets(elements: list) -> list[str]:
    """Ids of visible mentions, in order, once each."""
    out: dict[str, None] = {}
    for e in elements:
        if e.get("type") in INLINE or e.get("type") == "quote":
            out.update(dict.fromkeys(targets(_children(e))))
        elif e.get("type") == "at" and (e.get("attrs") or {}).get("type") != "all" and (who := _attr(e, "id")):
            out[who] = None
    return list(out)


def _parsed(s) -> list:
    try:
        tree = json.loads(s) if s else []
    except ValueError:
        return []
    return [e for e in tree if isinstance(e, dict)] if isinstance(tree, list) else []


def to_text(c) -> Column:
    @F.pandas_udf("string")
    def run(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: render(_parsed(t)))

    return run(col(c))


def mentioned(c) -> Column:
    @F.pandas_udf("array<string>")
    def run(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: targets(_parsed(t)))

    return run(col(c))
