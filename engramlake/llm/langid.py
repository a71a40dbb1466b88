"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits.  For each bit a binary classifier
over hashed byte n-grams separates the languages with +1 from those with -1:
its weights are log-ratios of the two sides' n-gram frequencies, counted over all
training rows in one distributed pass.  A text's margins are compared with every
codeword by a weighted logistic loss; the least loss wins, and a small gap
between the first two flags the text as ambiguous.

The model is a fixed-size table (buckets x bits).  Rows with null text or
language teach nothing.  A text that is null or has no letter is ``und`` with
score 0, as is every text where nothing was learned.  Repeated rows teach as often as they
stand; each row has its own prediction, the same for the same text; equal losses go to
the language that sorts first.  All n-grams of a text
count, by their share in it, so a mixture scores alike at every length.  In
training a text weighs as much as it has n-grams, ``WEIGHT`` at most, spread over
all of them by their shares, so no single text outweighs the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.common import by_bytes, text_batches

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
WEIGHT = 10_000
#: Training weights are added up as integers, so that sums do not depend on their order.
UNIT = 1 << 16
#: Bytes of a text counted at once; bounds memory on very long texts.
CHUNK = 1 << 20
UNDETERMINED = "und"
#: All ASCII but letters reads as a blank.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter to Unicode (categories L*)."""
    return any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams over the whole text."""
    data = b" " + b" ".join(text.lower().encode("utf-8").translate(BLANKED).split()) + b" "
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(data), CHUNK):
        piece = np.frombuffer(data, dtype=np.uint8, count=min(CHUNK + max(ORDERS) - 1, len(data) - at), offset=at).astype(np.uint32)
        for n in ORDERS:
            size = min(len(piece) - n + 1, CHUNK)
            if size <= 0:
                continue
            h = np.full(size, n, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(257) + piece[k : k + size]
            h *= np.uint32(2654435761)
            counts += np.bincount(h >> np.uint32(19), minlength=BUCKETS)
    return counts


def weighed(counts: np.ndarray) -> np.ndarray:
    """What a text teaches: its n-gram shares times its bounded weight, in units."""
    total = max(1, int(counts.sum()))
    return np.rint(counts * (UNIT * min(total, WEIGHT) / total)).astype(np.int64)


def codewords(n: int) -> np.ndarray:
    """(languages, bits): every split in two for up to 5 languages, else seeded dense random codes."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        splits = range(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 or not (s >> (i - 1)) & 1 else -1 for s in splits] for i in range(n)], dtype=np.int8)
    rng, bits, best = np.random.default_rng(7), int(np.ceil(12 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (buckets, bits)
    middle: np.ndarray  # (bits,) between the two sides
    half: np.ndarray  # (bits,) half the distance between them
    ambiguous: float = 0.2

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        counts = grams(text)
        margin = np.clip((counts @ self.weights / max(1, counts.sum()) - self.middle) / self.half, -3, 3)
        trust = self.half / self.half.sum()
        loss = np.log1p(np.exp(-2 * self.code * margin)) @ trust
        order = np.argsort(loss, kind="stable")
        chance = np.exp(-4 * (loss - loss[order[0]]))
        return self.langs[order[0]], float(chance[order[0]] / chance.sum()), bool(loss[order[1]] - loss[order[0]] < self.ambiguous)


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count n-grams by language over all labelled rows, then derive the bits' classifiers.

    Each task adds up its own rows; sums meet by (language, bucket), and only the
    finished table of languages x buckets comes to the driver.
    """
    by_bytes(labelled.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = weighed(grams(text))
                sums[lang] = sums[lang] + own if lang in sums else own
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    table = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    freq = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        freq[i, own["bucket"].to_numpy()] += own["n"].to_numpy() / UNIT
    freq /= freq.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    plus, minus = (code > 0).astype(float), (code < 0).astype(float)
    weights = np.log(freq.T @ plus / plus.sum(axis=0)) - np.log(freq.T @ minus / minus.sum(axis=0))
    mean = freq @ weights  # what each language's own texts score on each bit
    low = np.where(code > 0, mean, np.inf).min(axis=0)
    high = np.where(code < 0, mean, -np.inf).max(axis=0)
    return Model(langs, code, weights.astype(np.float32), (low + high) / 2, np.maximum((low - high) / 2, 1e-3))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (0 to 1), ambiguous: one row for each row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return text_batches(docs, id_col, text_col, lambda text: shared.value.predict(text), "lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id"):
    """The rows that never teach: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language can be told; texts without a letter go."""
    by_bytes(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([shared.value.predict(t)[0] != UNDETERMINED for t in batch.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
