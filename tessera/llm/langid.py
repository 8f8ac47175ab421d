"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector drawn from its code point. A three-letter gram binds
them by elementwise product after rotating the first by two places and the second by one. A
text bundles (sums) the vectors of its grams, a language bundles its texts, and a text goes
to the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text_arrow import CHUNK_BYTES, chunks, held
from tessera.runtime import read_table, ship_package

DIMENSIONS = 1024
#: At most about this many labelled rows (dealt by a hash of the id) teach the prototypes.
TRAIN_ROWS = 20_000
CACHE_GRAMS = 24_000


class Space:
    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.grams = np.empty((0, dimensions), np.float32)

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[cp, 20])).integers(0, 2, self.d)
            self.letters[cp] = (2 * bits - 1).astype(np.float32)
        return self.letters[cp]

    def bind(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of the grams, a row each."""
        cps, at = np.unique(np.concatenate([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF]), return_inverse=True)
        table = np.array([self.letter(int(c)) for c in cps], np.float32)
        a, b, c = at.reshape(3, -1)
        return np.roll(table, 2, axis=1)[a] * np.roll(table, 1, axis=1)[b] * table[c]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of the grams; the commonest stay in a table, the others are bound anew."""
        row, known = self.row, keys.tolist()
        new = [k for k in known if k not in row]
        extra = {}
        if new:
            made = self.bind(np.array(new, np.int64))
            room = max(0, CACHE_GRAMS - len(row))
            for k in new[:room]:
                row[k] = len(row)
            self.grams = np.concatenate([self.grams, made[:room]]) if room else self.grams
            extra = {k: i for i, k in enumerate(new[room:], max(0, min(room, len(new))))}
        if not extra:
            return self.grams[[row[k] for k in known]]
        return np.array([self.grams[row[k]] if k in row else made[extra[k]] for k in known], np.float32)

    def counts(self, text: str, step: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the letter grams and their counts; words are set off by one blank. A long text
        is read ``step`` characters at a time, and the last two letters go along."""
        low = text.lower()
        parts = []
        tail = np.array([32], np.int64)
        for start in range(0, len(low), step):
            cp = np.frombuffer(low[start : start + step].encode("utf-32-le", "replace"), np.uint32)
            cp = np.concatenate([tail, np.where(_letters()[cp], cp, 32).astype(np.int64), [32] if start + step >= len(low) else []]).astype(np.int64)
            cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
            parts.append(np.unique(cp[:-2] << 42 | cp[1:-1] << 21 | cp[2:], return_counts=True))
            tail = cp[-2:]
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text; None for a null text or one without letters."""
        keys, n = self.counts(text or "")
        if not len(keys):
            return None
        v = n.astype(np.float32) @ self.vectors(keys)
        size = float(np.linalg.norm(v))
        return v / size if size else np.zeros(self.d, np.float32)


_LETTERS: list = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def space(d: int) -> Space:
    return held(("space", d), lambda: Space(d))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Prototypes from rows with a language: bundled per partition, then summed per
    (language, place), so the driver gets languages x dimensions numbers."""
    ship_package(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull())
    total = known.select(id_col).count()
    if total > rows:
        cut = int(rows / total * (1 << 30))
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), F.col(id_col)), F.lit(1 << 30)) < cut)

    def partial(batches):
        import pyarrow as pa

        s, sums = space(dimensions), {}
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                for text, lang in zip(texts, part.column("l").to_pylist()):
                    v = s.bundle(text)
                    if v is not None:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["l", "v"])

    parts = known.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).mapInArrow(partial, "l string, v array<double>")
    sums = parts.select("l", F.posexplode("v")).groupBy("l", "pos").agg(F.sum("col").alias("x"))
    got = sums.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).orderBy("l").collect()
    langs = [r["l"] for r in got]
    table = np.array([[x["x"] for x in r["v"]] for r in got], float).reshape(len(langs), dimensions)
    table = np.round(table, 6)  # sums of partitions in any order
    size = np.linalg.norm(table, axis=1, keepdims=True) if len(langs) else 1
    return langs, table / np.where(size == 0, 1, size)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text", id_col: str = "doc_id",
            dimensions: int = DIMENSIONS) -> DataFrame:
    """id, lang_pred, score (the cosine with the prototype, moved to 0..1) for whole texts.

    ``und`` with score 0 for null texts, texts without letters, and when nothing was learned.
    Ties go to the language that sorts first. Only id and text are read, so other columns may
    have any names; repeated rows come back as often, and an empty table gives none.
    """
    ship_package(docs.sparkSession)
    table = prototypes.astype(np.float32)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        s = space(dimensions)
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                found = []
                for text in texts:
                    v = s.bundle(text) if langs else None
                    if v is None:
                        found.append(("und", 0.0))
                    else:
                        cos = table @ v
                        k = int(cos.argmax())
                        found.append((langs[k], float(min(1.0, max(0.0, (1 + cos[k]) / 2)))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                    names=["i", "lang_pred", "score"])

    picked = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return picked.mapInArrow(run, f"i {kind}, lang_pred string, score double").withColumnRenamed("i", id_col)


def held_out(remainder: int, parts: int, id_col: str = "doc_id"):
    """Whether the CRC-32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce((F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)) == F.lit(remainder), F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """A null id is held out of nothing: held_out is false, and its row may teach."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, prototypes = train(docs.where(~held_out(2, 4)))
    out = predict(docs, langs, prototypes)
    return out.select("doc_id", held_out(2, 4).alias("held_out"), "lang_pred", "score")
