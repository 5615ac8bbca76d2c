"""Operator 12: byte-level BPE encoding and decoding with ``tiktoken``.

A rank file (token bytes in base64 and their rank) and a pretoken pattern make
a ``tiktoken`` encoding without special tokens; nothing is downloaded.  Every
match of the pattern is merged separately, as the library does.

Long texts are cut at safe boundaries first, so that no call holds more than
about ``SLICE`` characters: between a character that is not white space and one
that is.  No alternative of the pattern goes on from one to the other, and its
only look-ahead stands behind white space; so the matches on both sides are
those of the whole text.  A very long run of white space, on which the
library's regular expression engine runs out of stack, is one match but for its
last character (the whole run at the end of a text) and goes to the merge as
such.  A long run of anything else has no boundary the pattern would respect and
stays whole; the library merges it in n log n.

Decoding is the concatenation of the tokens' raw bytes: ids that end inside a
UTF-8 sequence decode to the bytes they stand for, nothing is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import text_buffers, text_slices
from .common import schema_of, text_rows

#: Code points of a long text that are encoded in one call, and the length from
#: which a run of white space is taken apart by hand.
SLICE = 1 << 16
#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_BOUNDARY = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")
_WHITE_RUN = re.compile(f"[{WHITE}]{{{SLICE},}}")


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` cut at safe boundaries, each piece as short as it can be from
    ``size`` code points on."""
    at = 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


class Codec:
    """One vocabulary: whole texts to ids, ids to bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, piece: str) -> Iterator[list[int]]:
        at = 0
        for run in _WHITE_RUN.finditer(piece):
            yield self.library.encode_ordinary(piece[at:run.start()])
            at = run.end() if run.end() == len(piece) else run.end() - 1
            yield self.library._encode_single_piece(piece[run.start():at])
        yield self.library.encode_ordinary(piece[at:])

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if len(text) <= SLICE:
            return np.array(self.library.encode_ordinary(text), "<u4")
        return np.concatenate([np.array(ids, "<u4") for piece in slices(text) for ids in self._parts(piece)])

    def bytes(self, ids: np.ndarray) -> bytes:
        try:
            return self.library.decode_bytes(ids.tolist())
        except KeyError as e:
            raise ValueError(f"not an id of this vocabulary: {e}") from None


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    """The encoding, loaded once per worker process."""
    return Codec(ranks_path, pattern)


def rank_file(name: str = "byte_bpe_multi_50k") -> tuple[str, str]:
    """Path and pretoken pattern of an installed public rank file."""
    import public_tokenizers as p
    return p.path(f"{name}.tiktoken"), p.PATTERN


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", files: tuple[str, str] | None = None,
           packed: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_tokens`` and ``ids``, an array
    of integers, or with ``packed`` their little-endian unsigned 32-bit bytes.

    A null text counts as empty (no ids); a null key stays null; repeated rows
    give repeated results, an empty table an empty one; other columns are never
    read, whatever their names.  Texts of any length are encoded whole, a slice
    at a time; memory per task is one batch of rows (or one longer text) and its
    ids.  No shuffle; a lost task is run again by itself.
    """
    files = files or rank_file()
    kind = docs.schema[key].dataType.simpleString()
    schema, arrow = schema_of(f"k {kind}, n_tokens long, ids {'binary' if packed else 'array<int>'}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b)):
            each = [codec(*files).ids(t or "") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in each])
            if packed:
                ids = pa.array([x.tobytes() for x in each], pa.binary())
            else:
                flat = np.concatenate(each).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat)).cast(arrow.field("ids").type)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n, pa.int64()), ids], schema=arrow)

    rows = text_rows(docs, F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def decode(rows: DataFrame, ids: str = "ids", data: str = "data", files: tuple[str, str] | None = None) -> DataFrame:
    """``rows`` and a further binary column ``data``: the raw bytes that ``ids``
    (an array of integers, or packed) stand for; null for null.  An id that the
    vocabulary lacks raises.  A column named ``data`` is replaced.

    Repeated rows and null keys pass through, an empty table stays empty.
    """
    files = files or rank_file()
    if data in rows.columns:
        rows = rows.drop(data)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = rows.select("*", F.lit(None).cast("binary").alias(data)).schema
    arrow = to_arrow_schema(schema)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            own = (None if x is None else np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.array(x, np.int64)
                   for x in (v.as_py() for v in column))
            out = pa.array([None if x is None else codec(*files).bytes(x) for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), out], schema=arrow)

    return rows.mapInArrow(run, schema)


def op12_tiktoken_codec(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: digests of ids and bytes."""
    from ..sources.tables import read_table
    encoded = encode(read_table(spark, sf_dir, "documents"), packed=True)
    return decode(encoded).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
