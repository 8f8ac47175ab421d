"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every prefix of a byte string there is exactly one token that the merge procedure ends
it with. ``PrefixTable`` stores that token for each prefix: a token ``t`` ends prefix ``i``
if the token stored for the prefix before ``t`` and ``t`` itself stay apart under the
merges. Appending bytes extends the table without touching earlier entries, and an edit works
out entries until they are again what they were. Walking the table backwards gives the
encoding. That prefixes have one valid last token, and how two tokens are tested, is a
published algorithm for byte-pair encodings.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import public_tokenizers
from pyspark.sql import DataFrame

from tessera.llm.text_arrow import chunks, held
from tessera.runtime import read_table, ship_package

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Encoded pieces that a Python worker keeps; pieces beyond it are encoded again when met.
CACHE_PIECES = 250_000
#: Prefixes of pieces whose last token a worker keeps, and the longest of them in bytes.
PREFIXES = 300_000
PREFIX_BYTES = 9


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with the tables that the validity test needs, filled as they are asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: last tokens of prefixes met so far: they hang on the prefix alone, so pieces share them
        self.prefixes: dict[bytes, int] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._apart: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; (token, token) for a single byte and
        None for a token that no merge reaches."""
        if token not in self._split:
            text = self.bytes_of[token]
            if len(text) == 1:
                self._split[token] = (token, token)
            else:
                parts = self._merge(text, token)
                self._split[token] = tuple(parts) if len(parts) == 2 else None
        return self._split[token]

    def _merge(self, text: bytes, below: int) -> list[int]:
        """Plain merging with ranks under ``below`` only; used once per vocabulary entry."""
        parts = [bytes([b]) for b in text]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both together leaves exactly these two tokens."""
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 400_000:
                self._apart.clear()
            known = self._apart[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        # Undo merges from the newest on. No merge across the boundary may come before the
        # merges that are still standing on both sides.
        if self.split(a) is None or self.split(b) is None:
            return False
        ranks, text, limit = self.ranks, self.bytes_of, len(self.bytes_of) + 1
        while True:
            joined = ranks.get(text[a] + text[b])
            if joined is not None and joined < limit and self.split(joined) == (a, b):
                return False
            if a > b:
                limit, (left, right) = a, self.split(a)
                a = right
                if left == right == limit:  # a single byte: undo on the other side
                    limit, (left, right) = b + 1, self.split(b)
                    b = left
                    if left == right:
                        return True
            else:
                limit, (left, right) = b + 1, self.split(b)
                b = left
                if left == right == limit - 1:
                    limit, (left, right) = a, self.split(a)
                    a = right
                    if left == right:
                        return True


class PrefixTable:
    """Last tokens of all prefixes of one piece; grows by ``append``."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = []
        if text:
            self.append(text)

    def _token(self, end: int) -> int:
        """The last token of the prefix that ends at ``end``; shorter prefixes are known."""
        v, text, last = self.vocabulary, self.text, self.last
        for begin in range(max(0, end - v.longest), end):
            token = v.ranks.get(text[begin:end])
            if token is not None and (v.split(token) is not None if begin == 0 else v.apart(last[begin - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        v, start = self.vocabulary, len(self.text)
        text = self.text = self.text + more
        ranks, last, apart = v.ranks, self.last, v.apart  # the loop of ``_token``, for speed
        prefixes, room = v.prefixes, PREFIXES - len(v.prefixes)
        for end in range(start + 1, len(text) + 1):
            if end <= PREFIX_BYTES:
                token = prefixes.get(text[:end])
                if token is not None:
                    last.append(token)
                    continue
            for begin in range(max(0, end - v.longest), end):
                token = ranks.get(text[begin:end])
                if token is None:
                    continue
                if begin == 0:
                    if v.split(token) is not None:
                        last.append(token)
                        break
                elif apart(last[begin - 1], token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            if end <= PREFIX_BYTES and room > 0:
                prefixes[text[:end]] = last[-1]
                room -= 1

    def truncate(self, size: int) -> None:
        self.text, self.last = self.text[:size], self.last[:size]

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replace text[begin:end]; returns how many entries were worked out. Entries before
        ``begin`` stay. An entry hangs on the bytes and entries of the longest token before it
        alone, so once that many in a row are as they were, all further ones are too."""
        old, rest = self.last, len(self.text) - end
        self.text = self.text[:begin] + new + self.text[end:]
        self.last, same = old[:begin], 0
        for at in range(begin + 1, len(self.text) + 1):
            self.last.append(self._token(at))
            before = at - len(self.text) + len(old)  # the same bytes' place before the edit
            same = same + 1 if at > begin + len(new) and self.last[-1] == old[before - 1] else 0
            # the first prefixes have fewer bytes before them than later ones
            if same >= self.vocabulary.longest and min(at, before) > self.vocabulary.longest:
                self.last += old[before:]
                return at - begin
        return rest + len(new)

    def tokens(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Codec(dict):
    """piece -> little-endian 32-bit ids; whole pieces in the vocabulary are one token."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        import regex

        super().__init__()
        self.vocabulary = Vocabulary(load_ranks(path))
        self.pattern = regex.compile(pattern)
        self.find = self.pattern.findall

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(raw)
        ids = [whole] if whole is not None else PrefixTable(self.vocabulary, raw).tokens()
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(self) < CACHE_PIECES and len(piece) < 64:
            self[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class Document:
    """An encoded text that stays encoded under appends and edits.

    Pieces are cut by the pattern; an edit cuts anew from a piece before the edited one and
    stops where a new boundary behind the edit falls on an old one: the pattern looks ahead
    only, so from there on pieces are as they were. Pieces are encoded when first asked for
    and keep their ids.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, text
        self.pieces = codec.find(text)
        self.packed: list[bytes | None] = [None] * len(self.pieces)

    def ids(self) -> list[int]:
        for k, x in enumerate(self.packed):
            if x is None:
                self.packed[k] = self.codec[self.pieces[k]]
        return unpack(b"".join(self.packed)).tolist()

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, new: str) -> int:
        """Replace text[begin:end]; returns how many pieces were cut anew."""
        at, keep = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) < begin:
            at += len(self.pieces[keep])
            keep += 1
        while keep and (at > max(0, begin - 2) or self.pieces[keep - 1].isspace()):
            keep -= 1
            at -= len(self.pieces[keep])
        old, shift = at, len(new) - (end - begin)
        self.text = self.text[:begin] + new + self.text[end:]
        cut, resume = [], keep
        for m in self.codec.pattern.finditer(self.text, at):
            cut.append(m[0])
            if m.end() < begin + len(new):
                continue
            while resume < len(self.pieces) and old + shift < m.end():
                old += len(self.pieces[resume])
                resume += 1
            if old + shift == m.end() and old >= end:
                break
        else:
            resume = len(self.pieces)
        self.pieces[keep:resume] = cut
        self.packed[keep:resume] = [None] * len(cut)
        return len(cut)


def unpack(packed: bytes) -> array:
    import sys

    ids = array("I")
    ids.frombytes(packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    return held(("codec", path, pattern), lambda: Codec(path, pattern))


def encode_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = public_tokenizers.PATTERN,
    with_ids: bool = False,
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``vocabulary`` names a rank file of ``public_tokenizers`` or is a path. Returns the id,
    n_tokens, ids_sha256 and decoded_sha256, and the ids as array<int> with ``with_ids``. A
    null text is an empty one: no tokens, digests of nothing. Equal rows give equal rows, and
    an empty table none. Only the two columns are read, so other columns may have any names. A row is worked on
    alone, which bounds memory by the longest text.
    """
    ship_package(docs.sparkSession)
    path = vocabulary if "/" in vocabulary else None
    name = vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        c = codec(path or public_tokenizers.path(name), pattern)
        for batch in batches:
            for part, texts in chunks(batch, "t"):
                n, a, b, ids_out = [], [], [], []
                for text in texts:
                    packed = c.encode_packed(text) if text else b""
                    ids = unpack(packed)
                    n.append(len(ids))
                    a.append(hashlib.sha256(packed).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if with_ids:
                        ids_out.append(ids.tolist())
                arrays = [part.column("i"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["i", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    picked = docs.select(docs[id_col].alias("i"), docs[text_col].alias("t"))
    return picked.mapInArrow(run, schema).withColumnRenamed("i", id_col)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
