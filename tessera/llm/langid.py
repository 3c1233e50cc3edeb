"""Language identification by hyperdimensional profiles.

Every letter has a random bipolar vector.  A letter 3-gram binds three of them, each
rotated once more than the next, by componentwise product; a document bundles its 3-grams
by summing them; a language prototype bundles the normalised documents of that language.
The prediction is the prototype of largest cosine.

Prototypes are fitted on about ``FIT_PER_LANG`` documents of each language outside the
held-out fold, taken by a hash of the id; every document is scored over its whole text.
3-gram vectors are kept for a task, in bounded number, and end with it.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to
the language first in code-point order; repeated rows repeat their result; documents of
null language do not train; without any training document every text is ``und`` with score
0; an empty table gives no rows; other columns are not read by ``predict``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold_of, map_arrow, map_rows, read, sampled

DIMENSIONS = 1024
FIT_PER_LANG = 1000
#: Letters fold to so many symbols by code point; symbol 0 is whatever is no letter.
SYMBOLS = 127
SEED = 20240
UNKNOWN = "und"
#: How much better than the declared language the predicted one must be to contradict it.
MARGIN = 0.3
#: Letters of a text and texts taken on at a time, and 3-gram vectors a task keeps (4 KB each).
LETTERS_AT_ONCE, TEXTS_AT_ONCE, KEPT_GRAMS = 250_000, 64, 12_000


@functools.cache
def symbols() -> np.ndarray:
    """The symbol of each code point."""
    points = np.arange(0x110000)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, points % SYMBOLS + 1, 0).astype(np.uint8)


class Encoder:
    """Turns texts into bundles of bound 3-grams."""

    def __init__(self, dimensions: int = DIMENSIONS):
        rng = np.random.default_rng(SEED)
        letters = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS + 1, dimensions))
        self.rotated = [np.roll(letters, k, axis=1) for k in range(3)]
        self.symbol = symbols()
        self.slot = np.full((SYMBOLS + 1) ** 3, -1, np.int32)  # of each 3-gram met so far, its row in vectors
        self.vectors = np.empty((KEPT_GRAMS, dimensions), np.float32)
        self.n = 0

    def _learn(self, keys: np.ndarray) -> None:
        a, b, c = keys // (SYMBOLS + 1) ** 2, keys // (SYMBOLS + 1) % (SYMBOLS + 1), keys % (SYMBOLS + 1)
        n = self.n + len(keys)
        if n > len(self.vectors):
            grown = np.empty((n + 1024, self.vectors.shape[1]), np.float32)
            grown[:self.n] = self.vectors[:self.n]
            self.vectors = grown
        self.vectors[self.n:n] = self.rotated[2][a] * self.rotated[1][b] * self.rotated[0][c]
        self.slot[keys] = np.arange(self.n, n)
        self.n = n

    def counts(self, text: str | None) -> np.ndarray | None:
        """How often each known 3-gram is there; stretches without letters count as one blank."""
        out = None
        for at in range(0, len(text or ""), LETTERS_AT_ONCE):
            part = text[max(0, at - 2):at + LETTERS_AT_ONCE].lower()
            s = self.symbol[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
            if not s.any():
                continue
            s = np.concatenate([[0], s, [0]])
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
            s = s[keep]
            keys = (s[:-2] * (SYMBOLS + 1) + s[1:-1]) * (SYMBOLS + 1) + s[2:]
            slots = self.slot[keys]
            if (slots < 0).any():
                self._learn(np.unique(keys[slots < 0]))
                slots = self.slot[keys]
            found = np.bincount(slots)
            if out is not None:
                found = np.bincount(np.concatenate([np.arange(len(out)), np.arange(len(found))]), np.concatenate([out, found]))
            out = found
        return out

    def bundles(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Each document's vector at length 1, or None without a letter."""
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            if self.n > KEPT_GRAMS * 3 // 4:
                self.slot.fill(-1)
                self.n = 0
                self.vectors = self.vectors[:KEPT_GRAMS].copy() if len(self.vectors) > KEPT_GRAMS else self.vectors
            found = [self.counts(t) for t in texts[at:at + TEXTS_AT_ONCE]]
            matrix = np.zeros((len(found), self.n), np.float32)
            for row, c in zip(matrix, found, strict=True):
                if c is not None:
                    row[:len(c)] = c
            made = matrix @ self.vectors[:self.n]
            made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
            yield from (None if c is None else v for v, c in zip(made, found, strict=True))


def fit(docs: DataFrame, per_lang: int = FIT_PER_LANG, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their prototypes, from documents with a text and a language."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.empty((0, dimensions), np.float32)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, per_lang / n)))
    chosen = usable.where(sampled(share[F.col("lang")], "lang"))

    def run(batch, made):
        sums = {}
        for lang, v in zip(batch.column("lang").to_pylist(), made.bundles(batch.column("text").to_pylist()), strict=True):
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        return {"lang": list(sums), "v": [v.tolist() for v in sums.values()]}

    parts = map_arrow(chosen.select("lang", "text"), run, "lang string, v array<double>", lambda: Encoder(dimensions))
    # the sum of each component, over at most languages x dimensions groups
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in sums.collect():
        found.setdefault(r.lang, np.zeros(dimensions))[r.i] = r.x
    langs = sorted(found, key=lambda x: [ord(c) for c in x])
    prototypes = np.array([found[x] / np.linalg.norm(found[x]) for x in langs], np.float32).reshape(len(langs), dimensions)
    return langs, prototypes


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the cosine, 0 if negative)."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))

    def run(batch, made):
        langs, prototypes = shared.value
        preds, scores = [], []
        for v in made.bundles(batch.column("text").to_pylist()):
            if v is None or not langs:
                preds.append(UNKNOWN)
                scores.append(0.0)
            else:
                cosines = prototypes @ v
                k = int(np.argmax(cosines))
                preds.append(langs[k])
                scores.append(min(1.0, max(0.0, float(cosines[k]))))
        return {"doc_id": batch.column("doc_id"), "lang_pred": preds, "score": scores}

    kind = docs.schema["doc_id"].dataType.simpleString()
    dimensions = prototypes.shape[1]
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double", lambda: Encoder(dimensions))


def identified(docs: DataFrame, least: float = 0.0, margin: float = MARGIN) -> DataFrame:
    """The documents of known language, with the columns of ``docs``; a null ``lang`` becomes the predicted one.

    Rejected are documents without a letter, documents that score below ``least`` (a negative cosine
    scores 0, as in ``predict``), and documents whose declared language was learned but is contradicted:
    the predicted language's cosine exceeds the declared one's by more than ``margin``.  A document of a
    language that was not learned, and without any training document every one with a letter, stays as it is.
    """
    langs, prototypes = fit(docs.where(fold_of(F.col("doc_id")) != 0))
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes, least, margin))

    def known(batch, made):
        import pyarrow as pa

        langs, prototypes, least, margin = shared.value
        text, at = (batch.schema.get_field_index(c) for c in ("text", "lang"))
        place = {x: k for k, x in enumerate(langs)}
        declared, keep = batch.column(at).to_pylist(), []
        for i, v in enumerate(made.bundles(batch.column(text).to_pylist())):
            stays = v is not None
            if stays and langs:
                cosines = prototypes @ v
                best = int(np.argmax(cosines))
                stays = max(0.0, float(cosines[best])) >= least
                if declared[i] is None:
                    declared[i] = langs[best]
                elif declared[i] in place:
                    stays &= float(cosines[best] - cosines[place[declared[i]]]) <= margin
            keep.append(stays)
        columns = list(batch.columns)
        columns[at] = pa.array(declared, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    dimensions = prototypes.shape[1]
    return map_rows(docs, known, lambda: Encoder(dimensions))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, prototypes = fit(docs.where(fold_of(F.col("doc_id")) != 0))
    out = predict(docs, langs, prototypes)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
