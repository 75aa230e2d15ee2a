"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A stretch of text is summarised by its token ids.  Two neighbouring summaries join into
the summary of the joined text, so a text is encoded by halves, recursively, and decoded
by concatenation up the tree.  Joining re-encodes a window around the seam that grows
until nothing outside it can change:

* Between pieces.  No match of the split pattern has white space after a character that
  is none, so each place where a space or line feed follows a visible character is a
  piece boundary whatever stands around it.  The window grows outwards to the nearest
  such place in either half; the tokens beyond it are final.
* Within a piece.  A run without such a place that exceeds a leaf (a long line of letters,
  say) is split into its pieces and each piece is encoded by halves in turn.  A token
  sequence is the BPE encoding of its bytes exactly if each pair of neighbours is the
  encoding of its own bytes, so once the re-encoded window agrees with the token on
  either side, pair by pair, everything outside it is final.

The first rule needs a split pattern in which white space stands only at the start of a
match or in matches of nothing else, as in the patterns of the public byte-level
vocabularies; ``Codec`` refuses a pattern that breaks it on a probe text.

A leaf, of at most ``LEAF_CHARS`` characters, is encoded by the tokenizer library.

Edge cases: null and empty text have no tokens; a missing table of ranks raises; very long texts
and unbroken runs are encoded whole; repeated rows and null ids give a row each; an empty table gives
an empty result; all columns stay in ``tokenised``, and a clashing name is avoided.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import accumulate

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF_CHARS = 512
PIECE_LEAF_BYTES = 512
SEAM_CHARS = 48
KNOWN_PAIRS = 100_000

_BREAK = regex.compile(r"[!-~\p{L}\p{N}](?=[ \n])")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(
        self, path: str, pattern: str, *, leaf_chars: int = LEAF_CHARS, piece_leaf: int = PIECE_LEAF_BYTES
    ) -> None:
        ranks = load_ranks(path)
        self.ranks = ranks
        self.find = regex.compile(pattern)
        self.leaf_chars, self.piece_leaf = max(leaf_chars, 2), max(piece_leaf, 2)
        self.single = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        probe = "It's a1, b\n\n  c  9 'll"
        if any(_BREAK.search(x) for x in self.find.findall(probe)):
            raise ValueError("the split pattern has matches that go on after white space")
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.pairs: dict[tuple[int, int], bool] = {}

    # tokens of one piece

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= self.piece_leaf:
            return self.single._encode_single_piece(data)
        half = len(data) // 2
        return self._join_tokens(self.piece(data[:half]), self.piece(data[half:]))

    def _agree(self, a: int, b: int) -> bool:
        """The two tokens are the encoding of their joined bytes."""
        if (known := self.pairs.get((a, b))) is None:
            known = self.single._encode_single_piece(self.table[a] + self.table[b]) == [a, b]
            if len(self.pairs) < KNOWN_PAIRS:
                self.pairs[a, b] = known
        return known

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if self._agree(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = b"".join(map(self.table.__getitem__, left[len(left) - i :] + right[:j]))
            mid = self.single._encode_single_piece(window)
            grow_left = i < len(left) and not self._agree(left[-i - 1], mid[0])
            grow_right = j < len(right) and not self._agree(mid[-1], right[j])
            if not grow_left and not grow_right:
                return left[: len(left) - i] + mid + right[j:]
            i = min(len(left), 2 * i) if grow_left else i
            j = min(len(right), 2 * j) if grow_right else j

    # whole texts

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.single.encode_ordinary(text)
        half = len(text) // 2
        return self._join(text, half, self.encode(text[:half]), self.encode(text[half:]))

    def _join(self, text: str, seam: int, left: list[int], right: list[int]) -> list[int]:
        begin, end = self._boundary_before(text, seam), self._boundary_after(text, seam)
        mid = self._window(text[begin:end])
        keep = len(left) - self._count(reversed(left), len(text[begin:seam].encode()))
        skip = self._count(iter(right), len(text[seam:end].encode()))
        return left[:keep] + mid + right[skip:]

    def _boundary_before(self, text: str, seam: int) -> int:
        width = SEAM_CHARS
        while True:
            low = max(0, seam - width)
            found = [m.end() for m in _BREAK.finditer(text, low, seam) if m.end() < seam]
            if found or not low:
                return found[-1] if found else 0
            width *= 2

    def _boundary_after(self, text: str, seam: int) -> int:
        m = _BREAK.search(text, seam)
        return m.end() if m else len(text)

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.single.encode_ordinary(text)
        return [i for x in self.find.findall(text) for i in self.piece(x.encode())]

    def _count(self, ids, size: int) -> int:
        """How many of the ids make up ``size`` bytes."""
        n = 0
        while size > 0:
            size -= len(self.table[next(ids)])
            n += 1
        if size:
            raise AssertionError("a token crosses a piece boundary")
        return n

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return array("I", self.encode(text)).tobytes()

    def decode_bytes(self, packed: bytes) -> bytes:
        return self._up([self.table[i] for i in memoryview(packed).cast("I")])

    def decode(self, ids: list[int]) -> bytes:
        return self._up([self.table[i] for i in ids])

    def _up(self, leaves: list[bytes]) -> bytes:
        if len(leaves) <= self.leaf_chars:
            return b"".join(leaves)
        half = len(leaves) // 2
        return self._up(leaves[:half]) + self._up(leaves[half:])


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def tokenised(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text") -> DataFrame:
    """All columns, with ``text_col`` as its tokens decode (null: empty), and the tokens: their number
    n_tokens, token_ids and ids_sha256 (with underscores before a name that the frame has already)."""
    common.prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [common.free_name(docs, n) for n in ("n_tokens", "token_ids", "ids_sha256")]
    schema = common.with_fields(docs.schema, list(zip(names, ("bigint", "array<int>", "string"))))

    def run(batches):
        c = codec(path, pattern)
        for whole in batches:
            for batch in common.slices(whole, 4 << 20):
                packed = [c.encode_bytes(t or "") for t in batch.column(at).to_pylist()]
                ids = pa.ListArray.from_arrays(
                    pa.array(list(accumulate((len(p) // 4 for p in packed), initial=0)), pa.int32()),
                    pa.Array.from_buffers(pa.int32(), sum(map(len, packed)) // 4, [None, pa.py_buffer(b"".join(packed))]),
                )
                text = pa.array([c.decode_bytes(p) for p in packed], pa.binary()).cast(batch.schema.field(at).type)
                columns = list(batch.columns)
                columns[at] = text
                columns += [
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    ids,
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of tokens, digest of the ids and digest of the decoded bytes."""
    common.prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path, pattern)
        n, ids, back = [], [], []
        for text in batch.column(1).to_pylist():
            packed = c.encode_bytes(text or "")
            n.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            back.append(hashlib.sha256(c.decode_bytes(packed)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    fields = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return common.map_batches(docs, [id_col, text_col], rows, fields)


def op8(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), *public_vocabulary())
