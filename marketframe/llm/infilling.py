"""Fill-in-the-middle examples from seekable compressed frames.

A text is stored as independent zstandard frames of FRAME_CHARS code points, each with the number of
units (a run of ASCII letters, or any other single character) that start before its end. A cut at
unit k lies in the one frame that the counts name: only cut frames are decompressed for the selection,
and the frames between cuts go into the example as they are, still compressed. Digests stream an
example's frames in order; the original is rebuilt from the example alone, by the markers found in
its frames, without a whole text in memory.

The cuts, the form and its share are drawn by a hash of doc_id and `seed`:

* plain: the text is empty, holds a marker, or is one of every ten left as they are;
* psm: <P>prefix<S>suffix<M>middle, spm: <S>suffix<P>prefix<M>middle.

A null text is the empty text. A null doc_id is drawn as `null`. Repeated rows give repeated results;
rows are independent, so neither ties nor hot groups matter. A very long text is frames like others, also one
whose only unit is longer than a frame; a worker holds a bounded batch of texts, or one longer text. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketframe.llm.bpe import slices
from marketframe.llm.common import free_worker, map_arrow, settle

FRAME_CHARS = 32_768
LEVEL = 1
#: The markers.
P, S, M = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

_PACK, _UNPACK = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

FRAMES = "array<struct<data:binary,units:bigint,chars:bigint>>"
_FRAME = pa.list_(pa.struct([("data", pa.binary()), ("units", pa.int64()), ("chars", pa.int64())]))


def unit_starts(text: str, after_letter: bool = False) -> np.ndarray:
    """The places (code points) where units start; `after_letter`: the text goes on from a letter."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    low = c | 32
    letter = (low >= 97) & (low <= 122) & (c < 128)
    inner = letter.copy()  # letters behind a letter
    inner[1:] &= letter[:-1]
    if len(inner):
        inner[0] &= after_letter
    return np.flatnonzero(~inner)


def is_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def framed(text: str, size: int = FRAME_CHARS) -> list[tuple[bytes, int, int]]:
    """(compressed frame, units and code points up to its end) of a text."""
    out, units, letter = [], 0, False
    for at in range(0, len(text), size):
        part = text[at : at + size]
        units += len(unit_starts(part, letter))
        letter = is_letter(part[-1])
        out.append((packed(part.encode()), units, at + len(part)))
    return out


def packed(data: bytes) -> bytes:
    return _PACK.compress(data)


def unpacked(frame: bytes) -> bytes:
    return _UNPACK.decompress(frame)


class Stored:
    """A text in frames."""

    def __init__(self, frames: list[tuple[bytes, int, int]]):
        self.data = [f[0] for f in frames]
        self.units, self.chars = [0, *(f[1] for f in frames)], [0, *(f[2] for f in frames)]

    @property
    def n(self) -> int:
        return self.units[-1]

    def place(self, k: int) -> tuple[int, int, int]:
        """(frame, byte in the frame, code point in the text) where unit k starts; the end, for the
        number of all units. Only that frame is decompressed."""
        if k >= self.n:
            return len(self.data), 0, self.chars[-1]
        i = bisect_right(self.units, k) - 1
        text = unpacked(self.data[i]).decode()
        starts = unit_starts(text)
        goes_on = len(starts) - (self.units[i + 1] - self.units[i])  # 1 if its first unit began in the frame before
        at = int(starts[goes_on + k - self.units[i]])
        return i, len(text[:at].encode()), self.chars[i] + at

    def span(self, a: tuple[int, int, int], b: tuple[int, int, int]) -> list[bytes]:
        """Frames of what lies between two places: whole ones as they are, cut ones anew."""
        (i, x, _), (j, y, _) = a, b
        if i == j:
            return [packed(unpacked(self.data[i])[x:y])] if x < y else []
        head = [packed(unpacked(self.data[i])[x:])] if x else [self.data[i]]
        return head + self.data[i + 1 : j] + ([packed(unpacked(self.data[j])[:y])] if y else [])


def draws(doc_id: object, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit integers."""
    d = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[4 * i : 4 * i + 4], "big") for i in range(4)]


def example(text: Stored, marked: bool, doc_id: object, seed: int = 1) -> tuple[str, int | None, int | None, list[bytes]]:
    """form, prefix and middle in code points, and the example's frames."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text.n or marked or h3 % 100 >= PLAIN_FROM:
        return "plain", None, None, text.data
    a, b = (text.place(k) for k in sorted((h1 % (text.n + 1), h2 % (text.n + 1))))
    start, end = (0, 0, 0), text.place(text.n)
    prefix, middle, suffix = text.span(start, a), text.span(a, b), text.span(b, end)
    p, s, m = map(packed, (P, S, M))
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    parts = [s, *suffix, p, *prefix, m, *middle] if form == "spm" else [p, *prefix, s, *suffix, m, *middle]
    return form, a[2], b[2] - a[2], parts


def finds(frames: list[bytes], markers: tuple[bytes, ...]) -> list[int]:
    """Where (in bytes of the whole) each marker first stands, in one pass over the frames."""
    out, at, rest = dict.fromkeys(markers, -1), 0, b""
    for f in frames:
        data = rest + unpacked(f)
        for m in markers:
            if out[m] < 0 and (k := data.find(m)) >= 0:
                out[m] = at + k
        keep = min(len(data), max(map(len, markers)) - 1)
        at += len(data) - keep
        rest = data[len(data) - keep :]
    return [out[m] for m in markers]


def stretch(frames: list[bytes], a: int, b: int) -> Iterator[bytes]:
    """The bytes a to b of the whole, frame by frame; frames outside aren't decompressed."""
    at = 0
    for f in frames:
        n = zstandard.frame_content_size(f)
        if at < b and at + n > a:
            yield unpacked(f)[max(0, a - at) : b - at]
        at += n


def original(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text that an example was made of, in order, from its frames and form."""
    size = sum(map(zstandard.frame_content_size, frames))
    if form == "plain":
        yield from stretch(frames, 0, size)
        return
    p, s, m = finds(frames, (P, S, M))
    ends = {"psm": (s, m, size), "spm": (m, p, size)}[form]  # of prefix, suffix and middle
    for start, end in ((p + len(P), ends[0]), (m + len(M), ends[2]), (s + len(S), ends[1])):
        yield from stretch(frames, start, end)


def store(docs: DataFrame, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """doc_id, marked (the text holds a marker) and frames with units and code points up to their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for b in slices(batch):
                texts = [t or "" for t in b.column(1).to_pylist()]
                marked = [any(m.decode() in t for m in (P, S, M)) for t in texts]
                frames = [[dict(zip(("data", "units", "chars"), f)) for f in framed(t, frame_chars)] for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marked, pa.bool_()), pa.array(frames, _FRAME)], names=["doc_id", "marked", "frames"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, f"doc_id {kind}, marked boolean, frames {FRAMES}")


def examples(stored: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the example's frames, array<binary>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for b in slices(batch):
                ids = b.column(0).to_pylist()
                texts = [Stored([(f["data"], f["units"], f["chars"]) for f in row]) for row in b.column(2).to_pylist()]
                form, prefix, middle, parts = zip(*map(lambda t, m, d: example(t, m, d, seed), texts, b.column(1).to_pylist(), ids))
                columns = [pa.array([t.n for t in texts], pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(parts, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return map_arrow(stored.select("doc_id", "marked", "frames"), run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, frames array<binary>")


def _per_example(made: DataFrame, outs: dict[str, str], work) -> DataFrame:
    """The columns of `made` but frames, and those that `work` (frames, form) gives."""
    kept = [c for c in made.columns if c != "frames"]
    schema = ", ".join([*(f"{c} {made.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {k}" for c, k in outs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            for b in slices(batch):
                names = b.schema.names
                rows = [work(f, k) for f, k in zip(b.column(names.index("frames")).to_pylist(), b.column(names.index("form")).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(b.column(names.index(c)) for c in kept), *(pa.array(x, pa.string()) for x in zip(*rows))], names=[*kept, *outs])

    return map_arrow(made, run, schema)


def texts(made: DataFrame) -> DataFrame:
    """The examples as text: doc_id, n, form, prefix_chars, middle_chars and output."""
    return _per_example(made, {"output": "string"}, lambda frames, _: (b"".join(map(unpacked, frames)).decode(),))


def _digests(frames: list[bytes], form: str) -> tuple[str, str]:
    out, back = hashlib.sha256(), hashlib.sha256()
    for f in frames:
        out.update(unpacked(f))
    for part in original(frames, form):
        back.update(part)
    return out.hexdigest(), back.hexdigest()


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The examples of `docs`; texts are stored in frames in the shared folder first."""
    return examples(settle(store(docs), "frames"), seed)


def digest(docs: DataFrame) -> DataFrame:
    return _per_example(transform(docs), {"output_sha256": "string", "restored_sha256": "string"}, _digests)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, x, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""
