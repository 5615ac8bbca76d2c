"""Operator 3: secret scan with multipart credential linking.

Some parts of a credential are telling by themselves (strong): assignments to
password-like names, access key identifiers, long hex strings.  Others are
ordinary text unless their complement stands nearby (weak): user names and
account identifiers, opaque base64 strings and loosely named secrets, endpoint
addresses.  A weak part is reported only if, within its scope, it can be
completed to a credential:

* an identifier needs a secret,
* a secret needs an identifier,
* an endpoint needs both an identifier and a secret.

A part's scope reaches ``reach`` code points beyond either end.  Scopes and
parts are joined as intervals by a sweep: parts lie in order of their place
and every part learns the nearest end before it and the nearest start after it
for each role, from running maxima and minima in both directions.  That is the
interval join's outcome without its pairs, in n log n for any number of parts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, schema_of, staged, text_rows

#: Code points between the parts of one credential.
REACH = 240
# The base patterns and the lengths they need.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Kinds in their order: the base ones, then the weak ones and their roles.
BASE = ("assign", "access", "hex")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}
KINDS = tuple(ROLES)
_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
WEAK = {
    "identifier": re.compile(r"(?<![A-Za-z0-9])(?:client_?id|user_?name|user|login|account_?id|account|access_?key_?id|key_?id|tenant_?id)" + _NAMED + r"([A-Za-z0-9][A-Za-z0-9._@-]{2,})", re.ASCII | re.IGNORECASE),
    "key": re.compile(r"(?<![A-Za-z0-9])(?:pass|pwd|pw|credentials?|private_?key|access_?key|signing_?key|auth|bearer)" + _NAMED + r"([A-Za-z0-9+/_.=-]{8,})", re.ASCII | re.IGNORECASE),
    "endpoint": re.compile(r"""(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>|?]+|(?<![A-Za-z0-9.])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:\d{2,5}(?!\d)|(?<![A-Za-z0-9])(?:endpoint|host|hostname|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,})""", re.ASCII | re.IGNORECASE),
}
#: User and password before the host of an address.
USERINFO = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://([^\s"'<>|/?#:@]*):([^\s"'<>|/?#]+)@""", re.ASCII | re.IGNORECASE)
#: A whole address with its query.
ADDRESS = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>|]+""", re.ASCII | re.IGNORECASE)
#: An opaque string: long, with capitals, small letters and digits.
OPAQUE_LEAST = 32
OPAQUE = re.compile(rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{{{OPAQUE_LEAST},}}={{0,2}}(?![A-Za-z0-9+/=_-])", re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strong parts by place, then kind as listed."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def weak_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts by place.  Identifiers and keys stand unless a strong part or
    one of them before it overlaps; those of an address's userinfo go first.
    They stand inside endpoints, too, and a whole address (``scheme://``)
    stands whatever lies in it; other endpoints must not overlap a strong part
    or begin inside a part before them."""
    found, user = [], []
    if ":" in text or "=" in text:
        for kind, pattern in WEAK.items():
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
        if "://" in text:
            user = [(kind, *m.span(n)) for m in USERINFO.finditer(text) for n, kind in ((1, "identifier"), (2, "key")) if m.group(n)]
    inside = _overlaps([("", *m.span()) for m in ADDRESS.finditer(text)] if "://" in text else [])
    for m in OPAQUE.finditer(text):
        # a path is no opaque string, its pieces may be
        for a, b in _pieces(text, *m.span()) if inside(*m.span()) else [m.span()]:
            s = text[a:b]
            if any(map(str.isupper, s)) and any(map(str.islower, s)) and any(map(str.isdigit, s)):
                found.append(("key", a, b))
    out, end = [], -1
    strong, first, own = _overlaps(base), _overlaps(user), set(user)
    for kind, a, b in sorted(found + user, key=lambda s: (s[1], KINDS.index(s[0]))):
        if kind == "endpoint":
            if "://" in text[a:b] or a >= end and not strong(a, b):
                out.append((kind, a, b))
        elif not strong(a, b) and ((kind, a, b) in own or a >= end and not first(a, b)):
            out.append((kind, a, b))
            end = b
    return out


def _pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The parts of text[a:b] between slashes that are long enough to be opaque."""
    return [(a + m.start(), a + m.end()) for m in re.finditer(f"[^/]{{{OPAQUE_LEAST},}}", text[a:b])]


def _overlaps(spans: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether any of ``spans`` overlaps (a, b), asked by growing a."""
    left = iter(sorted((a, b) for _, a, b in spans))
    now = next(left, None)

    def overlaps(a: int, b: int) -> bool:
        nonlocal now
        while now and now[1] <= a:
            now = next(left, None)
        return bool(now and now[0] < b)
    return overlaps


def _parts(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    schema, arrow = schema_of(f"row long, k {kind}, base {span}, weak {span}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]
        for b in arrow_rows(batches):
            base, weak = [], []
            for t in b.column("text").to_pylist():
                strong = base_spans(t or "")
                base.append(named(strong))
                weak.append(named(weak_spans(t or "", strong)))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("k"), pa.array(base, arrow.field("base").type), pa.array(weak, arrow.field("weak").type)], schema=arrow)

    rows = text_rows(docs, F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _role(kind: Column) -> Column:
    out = F.lit(None)
    for k, role in ROLES.items():
        out = F.when(kind == k, F.lit(role)).otherwise(out)
    return out


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, base, weak) -> (row, spans): the weak parts that have their
    complement within reach; rows without any are left out."""
    spans = parts.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s", "s.kind", "s.start", "s.end")
    spans = spans.withColumn("role", _role(F.col("kind")))
    place = [F.col("start"), F.col("end"), F.col("kind")]
    ahead = Window.partitionBy("row").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(*(c.desc() for c in place)).rowsBetween(Window.unboundedPreceding, -1)
    near = {}
    for role in ("identifier", "secret"):
        before = F.max(F.when(F.col("role") == role, F.col("end"))).over(ahead)
        after = F.min(F.when(F.col("role") == role, F.col("start"))).over(back)
        near[role] = F.coalesce(F.col("start") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("end") <= reach, F.lit(False))
    spans = spans.withColumns({f"near_{r}": c for r, c in near.items()})
    complete = F.when(F.col("kind") == "identifier", F.col("near_secret")).when(F.col("kind") == "key", F.col("near_identifier")).when(F.col("kind") == "endpoint", F.col("near_secret") & F.col("near_identifier"))
    return spans.where(complete).groupBy("row").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``base`` and ``spans``, arrays of
    (kind, start, end) in code points, end exclusive, by start, then kind as
    in ``KINDS``; ``base`` has the strong parts, ``spans`` also linked ones.

    A null or empty text has none; null keys stay null; repeated rows give
    repeated results; an empty table an empty one; other columns are never
    read.  Texts are read once; only parts are written and shuffled.
    """
    parts = staged(_parts(docs, key, text))
    found = parts.join(linked(parts, reach), "row", "left")
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    both = F.expr(f"""transform(array_sort(transform(concat(base, coalesce(linked, array())),
        s -> struct(s.start AS start, array_position(array({kinds}), s.kind) AS nth, s.end AS end, s.kind AS kind))),
        s -> struct(s.kind AS kind, s.start AS start, s.end AS end))""")
    return found.select(F.col("k").alias(key), "base", both.alias("spans"))


def span_text(spans: str) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def covered(text: str, spans: list[dict]) -> str:
    """``text`` with every span (by start) replaced by its kind."""
    pieces, end = [], 0
    for s in spans:
        if s["start"] >= end:
            pieces += [text[end:s["start"]], f"[{s['kind']}]"]
        end = max(end, s["end"])
    return "".join([*pieces, text[end:]])


def redacted(docs: DataFrame, text: str = "text", reach: int = REACH, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``[kind]`` (spans that
    overlap become one, named by the first); the column ``length``, where
    there is one, is counted anew for changed texts.  No row goes.

    Texts are told apart by their 128-bit digest, so null or repeated keys do
    not matter.
    """
    digest = F.md5(F.col(f"`{text}`").cast("string"))
    own = docs.select(digest.alias("doc"), F.col(f"`{text}`").alias("text")).where("doc is not null")
    found = find_secrets(own, "doc", "text", reach).where(F.size("spans") > 0).groupBy("doc").agg(F.first("spans").alias("spans"))

    names = [f"c{i}" for i in range(len(docs.columns))]
    at, counted = names[docs.columns.index(text)], names[docs.columns.index(length)] if length in docs.columns else None
    rows = docs.toDF(*names).withColumn("doc", F.md5(F.col(at).cast("string"))).join(found, "doc", "left")
    schema = docs.toDF(*names).schema

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            b = b.select(names)
            hit = [i for i, found in enumerate(spans.is_valid().to_pylist()) if found]
            if hit:
                texts = b.column(at).to_pylist()
                counts = b.column(counted).to_pylist() if counted else None
                for i in hit:
                    texts[i] = covered(texts[i], spans[i].as_py())
                    if counts:
                        counts[i] = len(texts[i])
                columns = {at: texts} | ({counted: counts} if counted else {})
                arrays = [pa.array(columns[n], b.schema.field(n).type) if n in columns else b.column(n) for n in names]
                b = pa.RecordBatch.from_arrays(arrays, schema=b.schema)
            yield b

    return text_rows(rows, *names, "spans").mapInArrow(cover, schema).toDF(*docs.columns)


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from ..sources.tables import read_table
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    n = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *n, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
