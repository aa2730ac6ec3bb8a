"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand together in no vocabulary token can't end up in one token, so
no merge crosses them: such a pair is a certain cut. Cuts are taken where the pre-tokenizer, too,
reads both sides alone as it reads them together: before a space, after a letter, and between two
letters. The fragments between cuts are encoded independently, each distinct one once per
worker, and their ids are concatenated. Texts go through it by the batch: cuts are found over all
bytes of a batch at once, and ids are gathered by the numbers of distinct fragments.

Result of a null text: as of the empty text, no ids. Rows are independent: repeated rows give
repeated results, an empty table none. A text is encoded whole, however long; a worker holds about
PIECE_BYTES of texts at a time, or one longer text. The ids are little-endian unsigned 32-bit
integers in a binary column.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.common import free_worker, map_arrow, worker_cache

#: Bytes of fragments and ids a worker remembers before it starts anew.
MEMO_BYTES = 24_000_000
#: Bytes of texts or ids that are worked on at a time.
PIECE_BYTES = 1_000_000

_CODERS: dict[str, "FragmentCoder"] = worker_cache()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand
    for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def unseen_pairs(tokens: list[bytes]) -> np.ndarray:
    """(256, 256) booleans: true where no token holds the left byte before the right byte."""
    unseen = np.ones((256, 256), dtype=bool)
    for token in tokens:
        b = np.frombuffer(token, dtype=np.uint8)
        unseen[b[:-1], b[1:]] = False
    return unseen


class FragmentCoder:
    """Encoder and decoder of one tokenizer file; one lives in each Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        chars = byte_characters()
        self.to_char = dict(enumerate(chars))
        to_byte = {c: b for b, c in enumerate(chars)}
        self.added = {x.content.encode(): i for i, x in self.library.get_added_tokens_decoder().items()}
        self.bytes_of = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.bytes_of[i] = token.encode() if token.encode() in self.added else bytes(to_byte[c] for c in token)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self.one_word = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
        self.cut_kind = self._cut_kinds(unseen_pairs([t for i, t in enumerate(self.bytes_of) if t not in self.added]))
        self.byte_table = pa.array(self.bytes_of, pa.binary())
        self.memo: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def _cut_kinds(unseen: np.ndarray) -> np.ndarray:
        """By pair: 1 a certain cut, 2 one if the left side ends a letter U+00C0..U+00FF, 3 if the
        right side begins one, 4 if both do; 0 no cut."""
        kind = np.zeros((256, 256), dtype=np.uint8)
        letter = np.zeros(256, dtype=bool)
        letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        ascii_, tail = np.arange(256) < 0x80, (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
        kind[np.ix_(tail, ascii_)] = 2
        kind[letter, 0xC3] = 3
        kind[tail, 0xC3] = 4
        kind[np.ix_(letter, ascii_)] = 1
        kind[:, 0x20] = 1
        return np.where(unseen, kind, 0).astype(np.uint8).reshape(-1)

    def cuts(self, b: np.ndarray) -> np.ndarray:
        """Ascending places of all certain cuts in an array of bytes."""
        pair = b[:-1].astype(np.uint16)
        pair <<= 8
        pair |= b[1:]
        kind = self.cut_kind[pair]
        at = np.flatnonzero(kind)
        k = kind[at]
        if (k > 1).any():
            left = (b[np.maximum(at - 1, 0)] == 0xC3) & (b[at] != 0x97) & (b[at] != 0xB7)
            after = b[np.minimum(at + 2, len(b) - 1)]
            right = (after != 0x97) & (after != 0xB7)
            at = at[(k == 1) | ((k == 2) & left) | ((k == 3) & right) | ((k == 4) & left & right)]
        return at + 1

    def _learn(self, fragments: list[bytes]) -> None:
        """Encodes the distinct fragments that the memo doesn't hold yet."""
        memo = self.memo
        if self.held > MEMO_BYTES:
            memo.clear()
            self.held = 0
        one_word, to_char, merges, others = self.one_word.fullmatch, self.to_char, self.library.model.tokenize, []
        for f in fragments:
            if f in memo:
                continue
            if one_word(f):  # a single pre-token: straight to the merges
                memo[f] = array("I", [t.id for t in merges(f.decode("latin-1").translate(to_char))]).tobytes()
                self.held += 180
            else:
                others.append(f)
        if others:
            found = self.library.encode_batch_fast([f.decode() for f in others], add_special_tokens=False)
            for f, e in zip(others, found):
                memo[f] = array("I", e.ids).tobytes()
                self.held += 160 + len(f) + len(memo[f])

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of an array of texts, as binary; a null text counts as the empty text."""
        texts = pc.fill_null(texts, "").cast(pa.binary())
        if not len(texts):
            return pa.array([], pa.binary())
        ends = np.frombuffer(texts.buffers()[1], dtype="<i4")[texts.offset : texts.offset + len(texts) + 1]
        ends, data = ends - ends[0], texts.buffers()[2]
        if not ends[-1]:
            return pa.array([b""] * len(texts), pa.binary())
        data = data.slice(int(np.frombuffer(texts.buffers()[1], dtype="<i4")[texts.offset]), int(ends[-1]))
        if self.special is not None and self.special.search(data):
            return pa.array([self.encode(t) for t in texts.to_pylist()], pa.binary())
        return self._plain(data, ends)

    def _plain(self, data: pa.Buffer, ends: np.ndarray) -> pa.Array:
        """Ids of texts without special tokens that follow each other in `data`, parted at `ends`."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[self.cuts(np.frombuffer(data, dtype=np.uint8))] = True
        cut[ends] = True
        starts = np.flatnonzero(cut).astype("<i4")
        fragments = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), data]).dictionary_encode()
        distinct = fragments.dictionary.to_pylist()
        self._learn(distinct)
        ids = pa.array([self.memo[f] for f in distinct], pa.binary()).take(fragments.indices)
        places = np.frombuffer(ids.buffers()[1], dtype="<i4")[np.searchsorted(starts, ends)]
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(places), ids.buffers()[2]])

    def encode(self, text: bytes) -> bytes:
        """The ids of one text in UTF-8, which may hold special tokens."""
        parts = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):  # every other part is a special token
            if k % 2:
                parts.append(array("I", [self.added[part]]).tobytes())
            elif part:
                parts.append(self._plain(pa.py_buffer(part), np.asarray([0, len(part)]))[0].as_py())
        return b"".join(parts)

    def decode_column(self, ids: pa.Array) -> pa.Array:
        """The texts of an array of ids; null ids give the empty text. As in the library, unknown ids
        say nothing, and bytes that are no UTF-8 become U+FFFD."""
        ids = pc.fill_null(ids, b"")
        if not len(ids):
            return pa.array([], pa.string())
        ends = np.frombuffer(ids.buffers()[1], dtype="<i4")[ids.offset : ids.offset + len(ids) + 1]
        numbers = np.frombuffer(ids.buffers()[2] or b"", dtype="<u4", offset=int(ends[0]), count=int(ends[-1] - ends[0]) // 4)
        known = numbers < len(self.bytes_of)
        ends = np.concatenate(([0], np.cumsum(known)))[(ends - ends[0]) // 4]
        parts = self.byte_table.take(pa.array(numbers[known]))
        places = np.frombuffer(parts.buffers()[1], dtype="<i4")[ends] if len(parts) else np.zeros(len(ends), dtype="<i4")
        texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(places)), parts.buffers()[2]])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def coder(path: str) -> FragmentCoder:
    """The worker's coder for a file, loaded once."""
    free_worker(keep=_CODERS)
    if path not in _CODERS:
        _CODERS[path] = FragmentCoder(path)
    return _CODERS[path]


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, so that results of few long texts stand in memory at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with about PIECE_BYTES in a string or binary column, or with one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // PIECE_BYTES
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip([0, *ends], ends):
        if j > i:
            yield batch.slice(i, j - i)


def count_ids(ids: pa.Array) -> pa.Array:
    return pc.divide(pc.binary_length(ids).cast(pa.int64()), 4)


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """The columns of `keep`, `n_tokens` long and `ids` binary, a row for each input row.

    With `decoded_col` the same workers decode the ids again into a string column of that name.
    Columns of `keep` named like an own column give way to it; other columns are dropped.
    """
    path = tokenizer or default_tokenizer()
    own = ["n_tokens", "ids", *([decoded_col] if decoded_col else [])]
    kept = [c for c in keep if c not in own]
    source = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(_field(source, c) for c in kept), "n_tokens bigint", "ids binary", *([f"`{decoded_col}` string"] if decoded_col else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for part in pieces(batch, len(kept)):
                ids = c.encode_column(part.column(len(kept)))
                columns = [*part.columns[: len(kept)], count_ids(ids), ids]
                yield pa.RecordBatch.from_arrays([*columns, c.decode_column(ids)] if decoded_col else columns, names=[*kept, *own])

    return map_arrow(source, run, schema)


def decode(encoded: DataFrame, ids_col: str = "ids", out_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """All columns of `encoded` and `out_col` string, the text that its ids stand for (null ids:
    the empty text). An input column named `out_col` gives way to it."""
    path = tokenizer or default_tokenizer()
    source = encoded.select(*[c for c in encoded.columns if c != out_col])
    at = source.columns.index(ids_col)
    schema = ", ".join([*(_field(source, c) for c in source.columns), f"`{out_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for part in pieces(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, c.decode_column(part.column(at))], names=[*part.schema.names, out_col])

    return map_arrow(source, run, schema)


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the text decoded from them."""
    back = encode(docs, tokenizer=tokenizer, decoded_col="decoded")
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
