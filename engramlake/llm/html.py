"""Main-text extraction by maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive, tags negative or
positive by a weight learned from labelled pages: pages whose markup names one
article label each of their tokens as inside or outside of it, and a token
kind's weight is the log-ratio of the two shares.  One linear scan finds the
contiguous run of tokens with the greatest sum.  Where article or main elements
hold words they bound it: only their words score, the one with most words keeps
its tags free of cost, and the run is widened to all of each element it reaches
and cut to them.  Elements nested in one belong to it.  Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and comments never
count, inside the run or outside; such a box costs one bounded penalty, and none
between words of its own container.  A box that only its class or id tells, with
``MOST`` of the page's words and no article or main outside it, is no such box.

Character references are decoded, white space becomes one blank, blocks are
joined by one blank in page order; nothing else is dropped.  Null, empty and
text-free pages give the empty string.  Unclosed tags end with their parent.  Quotes
count in an attribute's value only where they begin it.  Each row has its own text,
repeated rows the same; of equal runs the first is taken, of articles with equally
many words the first.  Articles that hold less than a ``TEASER`` of the words of the
best run beside them bound nothing (a teaser next to the text).

Inside an article or main a class or id is noise only if each of its words is a word
of noise or a plain word (``related-posts``, ``commentlist``; not ``related-work`` or
``share-price``).  An id there is often an anchor: on headings, paragraphs, list items
and tables it tells nothing, on sections and lists only for readers' comments and
adverts.

Weights are learned from all pages of a small table, and from about ``SAMPLE_PAGES``
rows, chosen by hash, of a larger one.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import by_bytes, text_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Elements by kind.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SKIPPED = frozenset("head nav header footer aside form script style noscript template iframe svg canvas object embed button select option textarea input label dialog menu title xmp noembed noframes audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close their siblings when left open.
LOOSE = frozenset("p li dt dd tr td th option b i em strong a span font u small".split())
BODY = ("article", "main")
#: Words of classes and ids that name a box of the frame.
NOISE_WORD = (
    r"(?:ads?|advert\w*|adsense|adsbygoogle|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|menus?|nav|navbar|navigation|breadcrumbs?|sidebar|side|widgets?"
    r"|related|recommend\w*|share|sharing|social|comments?|disqus|respond|replies|reply|discussion|newsletter|subscri\w*|signup|login|footer|foot|header|masthead|topbar|toolbar|pagination|pager|toc|copyright|legal|disclaimer|skip)"
)
NOISE = re.compile(rf"(?:^|[\s_-]){NOISE_WORD}(?:$|[\s_-])", re.I)
WHOLE = re.compile(NOISE_WORD, re.I)
#: Words that may stand beside those of noise; they say where or how a box is, not what it is about.
PLAIN_WORDS = frozenset(
    "box boxes list lists section block area wrapper wrap container inner outer content contents item items link links bar buttons button form text top bottom left right main post posts page pages site article articles"
    " fixed sticky thread holder group panel row col slot unit card body title heading cta icon icons count zone module placeholder reader readers user users in on this us mobile desktop inline google fb facebook twitter".split()
)
FRAME_ONLY = frozenset("side legal disclaimer header".split())
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p figure table dl li dt dd blockquote".split())
PARTS = frozenset("section ul ol".split())
PART_IDS = re.compile(r"comments?|disqus|respond|replies|ads?|advert\w*|adsense|adsbygoogle", re.I)
CODE_TAGS = frozenset("span code pre i em b".split())
#: Elements whose words are those of the container around them.
FLOW = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot caption tr td th figure".split())
KNOWN = FLOW | SKIPPED | VOID | RAW | frozenset("html body div section article main hgroup address details summary fieldset legend figcaption picture center dir search slot".split())
MOST = 0.75
#: An article with less than this share of the words of the best run beside it is a teaser.
TEASER = 0.25
#: Rows that the weights are learned from, about, where a table has more.
SAMPLE_PAGES = 20_000
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())


def tells(word: str) -> bool:
    """Whether a word names noise, alone or written together with a plain word."""
    return WHOLE.fullmatch(word) is not None or any(word[k:] in PLAIN_WORDS and WHOLE.fullmatch(word[:k]) for k in range(2, len(word) - 1))


@lru_cache(maxsize=4096)
def named_noise(name: str, value: str, tag: str, inside: bool) -> bool:
    """Whether a class or id names noise."""
    if not inside:
        return NOISE.search(value) is not None or any(tells(w) for w in re.split(r"[\s_-]+", value.lower()) if w)
    if name == "id" and tag in ANCHORED:
        return False

    def counts(w):
        if w in FRAME_ONLY or name == "id" and (w == "discussion" or tag in PARTS and PART_IDS.match(w) is None) or tag in CODE_TAGS and w in ("comment", "comments"):
            return False
        return tells(w)

    for token in value.split():
        own = [w.lower() for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token) if w]
        if any(map(counts, own)) and all(tells(w) or w in PLAIN_WORDS or w[0].isdigit() or w.startswith("advert") for w in own):
            return True
    return False


def noisy(attrs: str, tag: str, inside: bool) -> str:
    """What tells that an element is noise: 'sure' or only its 'name' (class or id); else ''.  inside: within an article or main."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return ""
    found = ""
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and named_noise(name, value, tag, inside):
            found = "name"
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return "sure"
    return found


def tokens(page: str):
    """(kind, value, body, home) of each token that is in no skipped box.

    kind: 'word' with a text, 'open', 'close', 'noise' for a skipped box or 'gap'
    for its end with a tag.  body: number of the outermost article or main around,
    or 0.  home: number of the container around.
    """
    return [t for t in parsed(page) if t[0] != "inner"]


def parsed(page: str) -> list[tuple[str, str, int, int]]:
    """Tokens as above, and as 'inner' those in skipped boxes."""
    found, boxes = scanned(page)
    # a box that class or id alone would skip stays if it holds most of the page's words
    gone, outer = [False], [0]
    for box in boxes[1:]:
        up = box["up"]
        gone.append(gone[up] or not (box["words"] >= MOST * boxes[0]["words"] > 0 and box["bodied"] == boxes[0]["bodied"]))
        outer.append(outer[up] if gone[up] else box["body"])
    out = []
    for kind, value, body, home, box, after in found:
        if kind == "named":
            if gone[box]:
                kind, value, body = "inner", "", outer[box]
            elif after is None or gone[after]:
                kind, body = "noise", body if after is None else outer[after]
            else:
                kind = "open"
        elif kind in ("close", "gap"):
            if gone[after]:
                kind, body = "inner", outer[after]
            elif gone[box]:
                kind, body = "gap", outer[box]
        elif gone[box]:
            kind, value, body = "inner", "", outer[box]
        out.append((kind, value, body, home))
    return out


def scanned(page: str):
    """One pass: (kind, value, body, home, named box around, box after it) of each token, and the named boxes with their words; box 0 is the page."""
    stack: list[tuple[str, bool, int, int, int]] = []  # tag, skipped, body, home, named box
    at, bodies, homes, size = 0, 0, 0, len(page)
    total = bodied = 0
    boxes = [{"up": 0, "body": 0, "words": 0, "bodied": 0}]  # words before a box until it ends, then those in it
    found = []

    def cut(k):
        for box in {e[4] for e in stack[k:]} - {stack[k - 1][4] if k else 0}:
            boxes[box]["words"], boxes[box]["bodied"] = total - boxes[box]["words"], bodied - boxes[box]["bodied"]
        del stack[k:]

    top = ("", False, 0, 0, 0)
    while at < size:
        m = TOKEN.match(page, at)
        if m is None:
            break
        at = m.end()
        _, skipped, body, home, box = stack[-1] if stack else top
        if (text := m["text"] or m["cdata"]) is not None:
            if skipped:
                found.append(("inner", "", body, home, box, box))
            else:
                value = text if m["cdata"] else entities.unescape(text)
                n = len(value.split())
                total += n
                bodied += n if body else 0
                found.append(("word", value, body, home, box, box))
            continue
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if m["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
                if tag in LOOSE and stack[k][0] not in LOOSE:
                    break
            _, within, _, _, after = stack[-1] if stack else top
            found.append(("inner" if within else "gap" if skipped else "close", tag, body, home, box, after))
            continue
        if tag in LOOSE and tag not in INLINE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    cut(k)
                    break
                if stack[k][0] not in LOOSE:
                    break
            _, skipped, body, home, box = stack[-1] if stack else top
        why = "sure" if tag in SKIPPED else noisy(m["attrs"], tag, body > 0) if tag not in ("html", "body") else ""
        named = why == "name" and not skipped
        skip = skipped or why == "sure"
        stays = tag not in RAW and tag not in VOID and not m["attrs"].endswith("/")
        around, outside = box, body
        if tag in BODY and not skip and not body:
            bodies += 1
            body = bodies
        if named and stays:
            boxes.append({"up": around, "body": outside, "words": total, "bodied": bodied})
            box = len(boxes) - 1
        if skipped:
            found.append(("inner", "", body, home, around, around))
        elif named:
            found.append(("named", tag, body, home, around, box if stays else None))
        else:
            found.append(("noise" if skip else "open", tag, body, home, around, around))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif stays:
            if tag not in FLOW:
                homes += 1
                home = homes
            stack.append((tag, skip, body, home, box))
    cut(0)
    boxes[0]["words"], boxes[0]["bodied"] = total, bodied
    return found, boxes


def kind_of(tag: str) -> str:
    """A known element's name; all other names are one kind, so that the table of kinds is as small for every input."""
    return tag if tag in KNOWN else "other"


def label_counts(page: str | None) -> Counter:
    """(kind, inside) of the tokens of a page whose markup names one article; else nothing."""
    seen, out = [], Counter()
    page = page or ""
    for kind, value, body, _ in parsed(page):
        seen.append(("word" if kind == "word" else kind_of(value) if kind != "noise" and value else "noise", body, len(value.split()) if kind == "word" else 1))
    bodies = {b for _, b, _ in seen if b}
    if len(bodies) == 1:
        for kind, body, n in seen:
            out[(kind, body > 0)] += n
    return out


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weight of each token kind, from the labelled pages among all rows, or among about SAMPLE_PAGES rows of a larger table."""
    by_bytes(pages.sparkSession)
    rows, parts = pages.count(), 1 << 20
    if rows > SAMPLE_PAGES:
        pages = pages.where(F.pmod(F.xxhash64(*[c for c in (html_col, "page_id", "url") if c in pages.columns]), F.lit(parts)) < SAMPLE_PAGES * parts // rows)

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page))
        rows = sorted(total.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([i for (_, i), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["kind", "inside", "n"])

    counts = pages.select(html_col).mapInArrow(count, "kind string, inside boolean, n long").groupBy("kind").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
    table = counts.collect()  # a row for each of KNOWN, 'word', 'noise' and 'other' at most
    ins, outs = sum(r["i"] for r in table), sum(r["o"] for r in table)
    weights = {r["kind"]: math.log((r["i"] + 1) / (ins + 1)) - math.log((r["o"] + 1) / (outs + 1)) for r in table}
    # a word is worth 1 at most, so that links and other tags of a frame outweigh their few words; tags never speak for content
    return {k: min(1.0, max(0.5, w)) if k == "word" else max(-8.0 if k == "noise" else -4.0, min(2.0, w) - 2.0) for k, w in weights.items()}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum; (0, 0) if none is positive."""
    best, run, start, out = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, out = run, (start, i + 1)
    return out


def costs(kept: list[tuple], noise: float) -> list[float]:
    """The penalty of each skipped box: none if words of its container stand on both sides."""
    out, behind = [], Counter(t[3] for t in kept if t[0] == "word" and t[1].strip())
    before: set[int] = set()
    for kind, value, _, home in kept:
        if kind == "word" and value.strip():
            before.add(home)
            behind[home] -= 1
        out.append(noise if kind == "noise" and not (home in before and behind[home]) else 0.0)
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    kept = tokens(page or "")
    word, tag, noise = weights.get("word", 1.0), -1.5, max(-8.0, weights.get("noise", -8.0))
    scores = [word * len(t[1].split()) if t[0] == "word" else c if t[0] in ("noise", "gap") else weights.get(kind_of(t[1]), tag) for t, c in zip(kept, costs(kept, noise))]
    bodies: dict[int, float] = {}
    for kind, value, body, _ in kept:
        if body and kind == "word":
            bodies[body] = bodies.get(body, 0.0) + len(value.split())
    bounded = sum(bodies.values()) > 0
    if bounded:  # what stands beside the articles, each of which ends a run
        a, b = best_run([-math.inf if t[2] else s for t, s in zip(kept, scores)])
        bounded = sum(bodies.values()) >= TEASER * sum(len(t[1].split()) for t in kept[a:b] if t[0] == "word")
    if bounded:
        most = max(bodies, key=lambda b: (bodies[b], -b))
        a, b = best_run([max(s, 0.0) if t[2] == most else s if t[2] else min(s, 0.0) for t, s in zip(kept, scores)])
        reached = {t[2] for t in kept[a:b]} - {0}
        chosen = [t for t in kept if t[2] in reached]
    else:
        a, b = best_run(scores)
        chosen = kept[a:b]
    out = []
    for kind, value, _, _ in chosen:
        if kind == "word":
            out.append(value)
        elif kind != "noise" and value not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each page, without a shuffle."""
    weights = weights or learn_weights(pages)

    def one(page, url):
        text = main_text(page, weights)
        return url, text, len(text)

    return text_batches(pages, "page_id", "html", one, "url string, text string, n_chars long", "url")
