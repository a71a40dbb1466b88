"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

The merge list fixes how far to the right a decision can depend on the text: a
rule ``(x, y)`` is undone only by an earlier rule that takes a piece of ``y``'s
right edge, that one only by a still earlier rule, and so on.  Ranks fall along
such a chain, so :func:`sufficient_lookahead` sums its longest form.  The
:class:`Transducer` reads a word symbol by symbol, holds a buffer of a few
lookaheads and emits every token that ends a lookahead before the buffer's end;
its memory does not grow with the word.  Everything after a token boundary is
tokenised independently of what stands before it, so the buffer restarts there.

Every word goes through the transducer.  In front of it stands a bounded memo of
what it has emitted, and the different parts (what stands between blanks) of
some megabytes of text are looked up once each and dealt out by Arrow; both
change the speed, never the ids.  Texts are read in blocks cut at white space, or,
where there is none, inside a word whose transducer stays open for the next block.

:class:`Decoder` is one incremental state machine from ids to bytes to text; how
tokens are joined is its output rule.

Null and empty texts give no ids.  Long texts and words need no more memory
than short ones, apart from the text itself.  Added tokens of the vocabulary
file that stand in a text get their own id, as the library has it.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.common import by_bytes

BLOCK_CHARS = 1 << 16
#: Characters whose parts are looked up together.
TOGETHER = 1 << 23
#: Parts that a worker remembers, about 40 bytes each, and words, about 150 bytes each and up to twice as many.
MEMO = 1_000_000
MEMO_WORDS = 300_000
#: Longer parts and words are not remembered.
LONG_WORD = 256
ID_BITS = 24
ID_MASK, NONE = (1 << ID_BITS) - 1, 1 << 60
#: Symbols given to the transducer at once.
PUSHED = 256
#: Characters outside this class are alike in every Unicode version, and Arrow's split and the vocabulary's rule agree on their blanks.
RARE = re.compile("[^\x00-\x1b\x20-\u024f]")
BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")
#: Signs that are one kind to the vocabulary's rule and stand in none of its contractions and no added token.
SIGNS = frozenset('!"#$%&()*+,-./:;=?@[\\]^_`{}~')
ENDS = "".join(sorted(SIGNS))


def byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes, as byte-level vocabularies use them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def sufficient_lookahead(pairs: list[tuple[str, str]], length) -> int:
    """Symbols to the right of a token that decide whether it is final.

    pairs: the merges in rank order; length: symbols of a token.
    """
    made: dict[str, tuple[int, str]] = {}  # token: its earliest rank and right part
    ranks: dict[str, list[int]] = {}  # left part: ranks of its rules so far ...
    reach: dict[str, list[int]] = {}  # ... and the running maximum of what they look at
    longest = 1
    for rank, (x, y) in enumerate(pairs):
        extra, edge, limit = 0, y, rank
        while True:
            if own := ranks.get(edge):
                if k := bisect_left(own, limit):
                    extra = max(extra, reach[edge][k - 1])
            if edge not in made:
                break
            limit, edge = made[edge]
        need = length(y) + extra
        ranks.setdefault(x, []).append(rank)
        reach.setdefault(x, []).append(max(need, reach[x][-1] if reach.get(x) else 0))
        made.setdefault(x + y, (rank, y))
        longest = max(longest, need)
    return longest


class Vocabulary:
    """Merges, ids and added tokens of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # (left id, right id) as one integer: rank and merged id as one integer, so that the least is the earliest rule
        self.rules = {self.ids[x] << ID_BITS | self.ids[y]: r << ID_BITS | self.ids[x + y] for r, (x, y) in reversed(list(enumerate(merges)))}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t))
        self.alphabet = byte_alphabet()
        self.symbol = [self.ids[c] for c in self.alphabet]
        self.last_symbol = {self.ids[c]: self.ids[c + self.suffix] for c in self.alphabet}
        self.length = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in self.ids.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self._library = None

    def symbols(self, word: str) -> list[int]:
        return [self.symbol[b] for b in word.encode("utf-8")]

    def merge(self, symbols: list[int]) -> list[int]:
        """All merges over one buffer of ids, in place: the lowest rank first, leftmost among equals."""
        s, rule = symbols, self.rules.get
        found = [rule(a << ID_BITS | b, NONE) for a, b in zip(s, s[1:])]
        while found and (low := min(found)) < NONE:
            i = found.index(low)
            s[i] = own = low & ID_MASK
            del s[i + 1], found[i]
            if i:
                found[i - 1] = rule(s[i - 1] << ID_BITS | own, NONE)
            if i < len(found):
                found[i] = rule(own << ID_BITS | s[i + 1], NONE)
        return s

    def split(self, text: str) -> list[str]:
        """Words of a normalised text."""
        if RARE.search(text) is None:
            return self.words.findall(text.lower())
        if self._library is None:  # rarer letters: the library's own tables
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(self.alphabet)}
        norm = self._library.normalizer.normalize_str(text)
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in self._library.pre_tokenizer.pre_tokenize_str(norm)]


class Transducer:
    """Reads one word's symbols (ids of single bytes) in pieces and gives token ids as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.buffer = vocabulary, []

    def push(self, symbols: list[int]) -> list[int]:
        out = []
        for at in range(0, len(symbols), PUSHED):
            self.buffer += symbols[at : at + PUSHED]
            if len(self.buffer) > 4 * self.v.lookahead:
                # One symbol more may still come and carry the word's end, so none here has it.
                end, done = len(self.buffer) - self.v.lookahead, 0
                for token in self.v.merge(list(self.buffer)):
                    if done + self.v.length[token] > end:
                        break
                    done += self.v.length[token]
                    out.append(token)
                del self.buffer[:done]
        return out

    def close(self) -> list[int]:
        rest, self.buffer = self.buffer, []
        if rest:
            rest[-1] = self.v.last_symbol[rest[-1]]
            self.v.merge(rest)
        return rest


class Memo(dict):
    """Values of make(key) by key; the least recent half goes when size keys are full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Parted:
    """Ids of many texts, each different part of them encoded once.

    pieces(text): what is to be split at blanks (str) and ready ids (bytes), in
    order; split(part): the words of one part; word(word): the packed ids of one word.
    """

    def __init__(self, memo: int = MEMO, memo_words: int = MEMO_WORDS):
        self.memo, self.words = memo, Memo(self.word, memo_words)
        self.known, self.packed = pa.array([], pa.string()), pa.array([], pa.binary())

    def part(self, part: str) -> bytes:
        if len(part) <= LONG_WORD:
            letters = part.rstrip(ENDS)
            if letters.isascii() and letters.isalpha():  # one word, and one of signs behind it
                return self.words[letters] + self.words[part[len(letters) :]] if len(letters) < len(part) else self.words[letters]
        return b"".join([self.words[w] if len(w) <= LONG_WORD else self.word(w) for w in self.split(part)])

    def stream(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, its next packed ids), in order; texts without ids do not appear."""
        held, size = [], 0
        for k, text in enumerate(texts):
            for piece in self.pieces(text) if text else ():
                held.append((k, piece))
                size += len(piece)
                if size >= TOGETHER:
                    yield from self._dealt(held)
                    held, size = [], 0
        yield from self._dealt(held)

    def _dealt(self, held: list) -> Iterator[tuple[int, bytes]]:
        parts = pc.utf8_split_whitespace(pa.array([p for _, p in held if isinstance(p, str)], pa.string()))
        coded = parts.flatten().dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(pc.is_null(place))
        packed = pa.concat_arrays([self.packed, pa.array(map(self.part, fresh.to_numpy(zero_copy_only=False).tolist()), pa.binary())])
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).copy()
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        taken = packed.take(pa.array(place[coded.indices.to_numpy()]))
        short = pc.less_equal(pc.binary_length(coded.dictionary), LONG_WORD)
        if len(packed) <= self.memo and pc.all(short, min_count=0).as_py():
            self.known, self.packed = pa.concat_arrays([self.known, fresh]), packed
        else:  # only what this text needed is kept, and nothing long
            self.known, self.packed = coded.dictionary.filter(short), packed.take(pa.array(place)).filter(short)
        ends, at = np.frombuffer(taken.buffers()[1], dtype=np.int32) if len(taken) else np.zeros(1, np.int32), parts.offsets.to_numpy()
        data, i = taken.buffers()[2] if len(taken) else b"", 0
        for k, piece in held:
            if isinstance(piece, str):
                piece, i = bytes(data[ends[at[i]] : ends[at[i + 1]]]), i + 1
            if piece:
                yield k, piece

    def encode(self, text: str | None) -> bytes:
        return b"".join(ids for _, ids in self.stream([text]))


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def plain(block: str) -> bool:
    """Whether no character of the block is RARE."""
    if any(c in block for c in "\x1c\x1d\x1e\x1f"):
        return False
    if block.isascii():
        return True
    try:
        block.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return RARE.search(block) is None


class Encoder(Parted):
    """The transducer's ids, 4 bytes each, little-endian."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO, memo_words: int = MEMO_WORDS):
        self.v, self.split = vocabulary, vocabulary.words.findall
        super().__init__(memo, memo_words)

    def word(self, word: str) -> bytes:
        machine = Transducer(self.v)
        early = machine.push(self.v.symbols(word))
        return packed(early + machine.close())

    def pieces(self, text: str) -> Iterator[str | bytes]:
        for own in self.v.cut.split(text) if self.v.cut and "<" in text else (text,):
            if (i := self.v.added.get(own)) is not None:
                yield i.to_bytes(4, "little")
                continue
            machine = None
            for block, goes_on in word_blocks(own):
                if machine is None and not goes_on and plain(block):
                    yield block.lower()
                    continue
                words = self.v.split(block)
                for k, word in enumerate(words):
                    machine = machine or Transducer(self.v)
                    yield packed(machine.push(self.v.symbols(word)))
                    if not goes_on or k < len(words) - 1:
                        yield packed(machine.close())
                        machine = None


def word_blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[tuple[str, bool]]:
    """(piece of one to two sizes, whether its last word goes on in the next piece), cut before white space, else inside a word."""
    at = 0
    while len(text) - at > 2 * size:
        if m := BLANK.search(text, at + size, at + 2 * size):
            cut, inside = m.start(), False
        else:
            cut, inside = next(((c, w) for c in range(at + size, len(text)) if (w := _inside(text, c)) is not None), (len(text), False))
        yield text[at:cut], inside
        at = cut
    if at < len(text) or not text:
        yield text[at:], False


def _inside(text: str, at: int) -> bool | None:
    """Whether a cut there is inside one word; None: not a place to cut, because what stands on one side may change the other."""
    before, b = text[at - 3 : at], text[at]
    a = before[-1]
    if b in SIGNS and a in SIGNS:
        return True
    if a.isascii() and b.isascii() and a.isdigit() and b.isdigit() or BLANK.match(b):
        return False
    if before.isalpha() and b.isalpha() and len(a.lower()) == len(b.lower()) == 1 and not unicodedata.combining(b) and unicodedata.is_normalized("NFC", a + b):
        return True
    return None


class Decoder:
    """Ids to text in pieces: each id gives bytes, and bytes of a split character wait until it is whole.

    form: 'joined', the library's own for a vocabulary without a decoder (token
    names with one blank between them), or 'plain', the text that was encoded
    (the byte alphabet undone, a blank at each word's end).
    """

    def __init__(self, vocabulary: Vocabulary, form: str = "joined"):
        names = [vocabulary.names[i] for i in range(max(vocabulary.names) + 1)]
        back, end = {c: b for b, c in enumerate(vocabulary.alphabet)}, vocabulary.suffix

        def raw(name: str) -> bytes:
            if form == "joined":
                return b" " + name.encode("utf-8")
            if name in vocabulary.added:
                return name.encode("utf-8")
            ends = bool(end) and name.endswith(end)
            return bytes(back[c] for c in (name.removesuffix(end) if ends else name)) + (b" " if ends else b"")

        self.table, self.skip = pa.array(map(raw, names), pa.binary()), int(form == "joined")
        self.start()

    def start(self) -> None:
        """The state before the first id of a text."""
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def push(self, ids: bytes) -> str:
        """The text that these ids, 4 bytes each, complete."""
        if not len(ids):
            return ""
        taken = self.table.take(pa.array(np.frombuffer(ids, dtype="<u4").astype(np.int32)))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int32)
        begin, self.first = self.skip if self.first else 0, False
        return self.state.decode(taken.buffers()[2][begin : int(ends[len(taken)])])

    def close(self) -> str:
        """What is left at the end of a text; the machine is ready for the next one."""
        rest = self.state.decode(b"", final=True)
        self.start()
        return rest


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(Vocabulary(path))


@lru_cache(maxsize=4)
def decoder(path: str, form: str = "joined") -> Decoder:
    return Decoder(encoder(path).v, form)


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 [, ids binary] of each row.

    One pass over the rows without a shuffle.  A null or empty text has no ids.
    """
    by_bytes(docs.sparkSession)
    kind = T.StructType([docs.schema[id_col], *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")).fields])

    def run(batches):
        enc, dec = encoder(path), decoder(path)
        for batch in batches:
            n, rows, kept = np.zeros(len(batch), dtype=np.int64), [(hashlib.sha256().hexdigest(),) * 2] * len(batch), {}
            open_text, ids, decoded = None, None, None

            def finish():
                decoded.update(dec.close().encode("utf-8"))
                rows[open_text] = (ids.hexdigest(), decoded.hexdigest())

            for k, block in enc.stream(batch.column(1).to_pylist()):
                if k != open_text:
                    if open_text is not None:
                        finish()
                    open_text, ids, decoded = k, hashlib.sha256(), hashlib.sha256()
                ids.update(block)
                decoded.update(dec.push(block).encode("utf-8"))
                n[k] += len(block) // 4
                if with_ids:
                    kept.setdefault(k, []).append(block)
            if open_text is not None:
                finish()
            more = [pa.array([b"".join(kept.get(k, ())) for k in range(len(batch))], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), *more], names=kind.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, kind)
