"""Quality rules from tokeniser fertility, with whole-text counts as a base.

Public vocabularies split every distinct word once; a document's figures are then counts
over its words: characters per token, share of byte-fallback tokens and entropy of its
tokens. Each script has a band for each figure, and a document outside one is rejected.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text_arrow import chunks, held
from tessera.runtime import read_table, ship_package

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 80_000
#: Bytes of text measured together; its arrays are what a task holds.
PIECE_BYTES = 1_500_000
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"

#: script: (least, most) characters per piece token, (least, most) characters per byte-level
#: token, most byte-fallback share, least bits of token entropy: at 181 tokens, more for each
#: doubling, and at most. The Latin band lies below all documents labelled as good in the test
#: tables; tables of words, strings of signs and endless lists lie under it.
BANDS = {
    "latin": ((1.1, 9.0), (1.75, 9.0), 0.20, (5.3, 0.35, 6.2)),
    "cyrillic": ((1.0, 9.0), (0.6, 9.0), 0.25, (2.5, 0.0, 2.5)),
    "greek": ((0.4, 9.0), (0.4, 9.0), 0.60, (2.5, 0.0, 2.5)),
    "arabic": ((0.4, 9.0), (0.4, 9.0), 0.60, (2.5, 0.0, 2.5)),
    "hebrew": ((0.4, 9.0), (0.4, 9.0), 0.60, (2.5, 0.0, 2.5)),
    "devanagari": ((0.3, 9.0), (0.3, 9.0), 0.80, (2.5, 0.0, 2.5)),
    "cjk": ((0.25, 4.0), (0.2, 4.0), 0.90, (2.5, 0.0, 2.5)),
    "other": ((0.2, 9.0), (0.2, 9.0), 0.97, (2.5, 0.0, 2.5)),
    "none": ((1.1, 9.0), (1.1, 9.0), 0.20, (2.5, 0.0, 2.5)),
}
#: Code point ranges of the scripts, ends included.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0x20000, 0x3134F)),
}
NAMES = [*SCRIPTS, "other", "none"]


def _script_table() -> np.ndarray:
    table = np.full(0x110000, len(SCRIPTS), np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            table[a : b + 1] = k
    # ASCII and Latin-1 signs belong to no script
    for cp in range(0x100):
        if not chr(cp).isalpha():
            table[cp] = len(SCRIPTS) + 1
    table[0x2000:0x2070] = table[0x3000:0x3030] = len(SCRIPTS) + 1
    return table


class Fertility:
    """word -> ids of the piece vocabulary, number of byte pieces and of byte-level tokens."""

    def __init__(self, pieces: str, byte_level: str):
        import sentencepiece
        import tiktoken

        from tessera.llm.bpe import load_ranks

        self.sp = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(byte_level), special_tokens={})
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.known: dict[bytes, tuple[tuple[int, ...], int]] = {}
        self.scripts = _script_table()

    def split(self, words: list[bytes]) -> list[tuple[tuple[int, ...], int]]:
        known = self.known
        new = [w for w in words if w not in known]
        extra = {}
        if new:
            text = [w.decode("utf-8", "replace") for w in new]
            first = self.sp.encode(text, num_threads=1)
            one = self.enc.encode_ordinary
            for w, t, ids in zip(new, text, first):
                extra[w] = (tuple(ids), len(one(" " + t)))
            room = CACHE_WORDS - len(known)
            for w in new[: max(0, room)]:
                known[w] = extra[w]
        return [known.get(w) or extra[w] for w in words]


def _repeat_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, base: int) -> np.ndarray:
    """Per document, the words inside three-word windows that it holds twice or more."""
    out = np.zeros(n_docs, np.int64)
    if len(ids) < 3:
        return out
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    a, b, c = (ids[inside + k].astype(np.int64) for k in range(3))
    ab = a * base + b
    if base >= 1 << 21:
        ab = np.unique(ab, return_inverse=True)[1]
    tri = np.unique(ab * base + c, return_inverse=True)[1].astype(np.int64)
    key = doc[inside].astype(np.int64) * (int(tri.max(initial=0)) + 1) + tri
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    again = inside[count[where] > 1]
    mark = np.zeros(len(ids), bool)
    for k in range(3):
        mark[again + k] = True
    np.add.at(out, doc[mark], 1)
    return out


def measure(texts: list, fertility: Fertility) -> dict[str, np.ndarray]:
    n = len(texts)
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    split = pc.ascii_split_whitespace(pa.array(raw, pa.binary()).cast(pa.large_binary()).cast(pa.large_string(), safe=False))
    offsets = split.offsets.to_numpy()
    flat = split.flatten()
    lengths = pc.binary_length(flat).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    full = lengths > 0
    flat, doc = flat.filter(pa.array(full)), doc[full]
    coded = flat.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    n_words = np.bincount(doc, minlength=n)
    word_chars = np.array([len(t or "") - (len(b) - len(b.translate(None, SPACE))) for t, b in zip(texts, raw)], np.int64)
    n_symbols = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64)
    n_dup = np.zeros(n, np.int64)
    for i, b in enumerate(raw):
        lines = [x for x in b.split(b"\n") if x.strip()]
        n_dup[i] = len(lines) - len(set(lines))
    repeat = _repeat_words(ids, doc, n, max(1, len(words)))
    parts = fertility.split(words)
    size = np.fromiter((len(p[0]) for p in parts), np.int64, len(parts))
    start = np.concatenate([[0], np.cumsum(size)])
    tokens = np.fromiter(chain.from_iterable(p[0] for p in parts), np.int64, int(start[-1]))
    level = np.fromiter((p[1] for p in parts), np.int64, len(parts))
    fallback = np.zeros(len(parts), np.int64)
    if len(tokens):
        fallback = np.diff(np.concatenate([[0], np.cumsum(fertility.is_byte[tokens])])[start])
    per_doc = lambda v: np.bincount(doc, weights=v[ids] if len(v) else None, minlength=n) if len(ids) else np.zeros(n)
    n_pieces, n_level, n_fallback = per_doc(size), per_doc(level), per_doc(fallback)
    # entropy of the piece tokens of a document
    entropy = np.zeros(n)
    if len(ids):
        reps = size[ids]
        at = np.repeat(start[ids] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(int(reps.sum()))
        key = np.repeat(doc, reps) * np.int64(len(fertility.is_byte)) + tokens[at]
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        count = np.diff(np.append(edge, len(key))).astype(float)
        owner = (key[edge] // len(fertility.is_byte)).astype(int) if len(key) else edge
        part = count * np.log2(count)
        total = np.maximum(n_pieces, 1)
        entropy = np.log2(total) - np.bincount(owner, weights=part, minlength=n) / total
    script = np.full(n, len(NAMES) - 1)
    for i, t in enumerate(texts):
        if t:
            cp = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
            seen = np.bincount(fertility.scripts[cp], minlength=len(NAMES))[: len(NAMES) - 1]
            if seen.any():
                script[i] = int(seen.argmax())
    cpt = word_chars / np.maximum(n_pieces, 1)
    cpl = word_chars / np.maximum(n_level, 1)
    share = n_fallback / np.maximum(n_pieces, 1)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup,
            "n_repeat_words": repeat, "script": script, "chars_per_token": cpt, "chars_per_byte_token": cpl,
            "fallback_share": share, "token_entropy": np.maximum(entropy, 0.0), "n_tokens": n_pieces}


def within_bands(m: dict[str, np.ndarray], bands: dict) -> np.ndarray:
    table = [bands[s] for s in NAMES]
    pick = lambda f: np.array([f(b) for b in table])[m["script"]]
    return (
        (m["chars_per_token"] >= pick(lambda b: b[0][0])) & (m["chars_per_token"] <= pick(lambda b: b[0][1]))
        & (m["chars_per_byte_token"] >= pick(lambda b: b[1][0])) & (m["chars_per_byte_token"] <= pick(lambda b: b[1][1]))
        & (m["fallback_share"] <= pick(lambda b: b[2])) & (m["token_entropy"] >= np.minimum(pick(lambda b: b[3][2]), pick(lambda b: b[3][0]) + pick(lambda b: b[3][1]) * (np.log2(np.maximum(m["n_tokens"], 1)) - 7.5)))
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    pieces: str = PIECES,
    byte_level: str = BYTES,
    bands: dict | None = None,
    min_words: int = 50,
    carry: bool = False,
) -> DataFrame:
    """Base counts, fertility figures and the verdict for every whole text.

    base_failed: fewer than ``min_words`` words, or more than half of them in repeated
    three-word windows. kept: not base_failed and within the bands of the text's main
    script. A null or empty text has no words and fails the base rule. Ties between scripts
    go to the first of SCRIPTS. With ``carry`` the input columns come back too (the figures'
    names win over clashing ones by a leading ``q_``). Each row is judged alone.
    """
    out, names = _judge(docs, id_col, text_col, pieces, byte_level, bands, min_words, carry)
    if not carry:
        return out.withColumnRenamed("i", id_col)
    taken = {c.lower() for c in docs.columns}
    return out.select(*[out[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)], *[out[n].alias(f"q_{n}" if n in taken else n) for n in names])


def _judge(docs, id_col="doc_id", text_col="text", pieces=PIECES, byte_level=BYTES, bands=None, min_words=50, carry=True, good_only=False):
    """The rows with their figures, input columns as c0, c1, ... so that no names clash; each column
    goes to Python once. With ``good_only`` the kept rows alone come back, without figures."""
    ship_package(docs.sparkSession)
    bands = bands or BANDS
    whole = pieces, byte_level
    if carry:
        first = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)])
        text, back = f"c{docs.columns.index(text_col)}", first.columns
    else:
        first = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
        text, back = "t", ["i"]

    def run(batches):
        f = held(("fertility", *whole), lambda: Fertility(*(p if "/" in p else public_tokenizers.path(p) for p in whole)))
        for batch in batches:
            for part, texts in chunks(batch, text, PIECE_BYTES):
                m = measure(texts, f)
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                kept = ~failed & within_bands(m, bands)
                if good_only:
                    yield part.filter(pa.array(kept))
                    continue
                longs = [pa.array(m[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in back), *longs, pa.array(failed), pa.array(kept), pa.array([NAMES[i] for i in m["script"]]),
                     *(pa.array(m[k], pa.float64()) for k in ("chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy"))],
                    names=[*back, *OUT])

    OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script",
           "chars_per_token", "chars_per_byte_token", "fallback_share", "token_entropy"]
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["string"] + ["double"] * 4
    figures = [] if good_only else [f"{n} {k}" for n, k in zip(OUT, kinds)]
    schema = ", ".join([*(f"{c} {first.schema[c].dataType.simpleString()}" for c in back), *figures])
    return first.mapInArrow(run, schema), OUT


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    judged, _ = _judge(docs, good_only=True, **options)
    return judged.toDF(*docs.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
