"""Fill-in-middle transformation (12): documents as piece tables.

A document is a list of descriptors (buffer, start, end) over buffers that never change: its own
bytes and the bytes of a sentinel. Cutting splits descriptors, an arrangement puts them in another order
with sentinels between them, and the inverse order gives the document back. No step copies text; digests
are fed descriptor by descriptor, and bytes are joined once, for the output column.

A text is cut into units, words with the white space before them (white space at the end is one more).
Prefix, middle and suffix end at unit bounds that hashes of seed and id choose, so reruns agree. Output
forms: `psm` is <P> prefix <S> suffix <M> middle, `spm` is <S> suffix <P> prefix <M> middle, `plain` is the text.

No shuffle: each task holds one batch of rows, whose texts are handled one at a time.

Defined cases: a null text is the empty text; an empty text, or one that holds a sentinel, is plain, so
an output can always be taken apart; a null id draws like the empty string; repeated rows give
repeated outputs; an empty table gives no rows. Other columns are passed on by `fill_in_middle`;
result columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
MOVED_PERCENT = 50  # of the documents
SPM_PERCENT = 80  # of those
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What each form puts after which sentinel; parts are 0 prefix, 1 middle, 2 suffix.
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
SENTINELS = {name: name.encode() for name in (PREFIX, SUFFIX, MIDDLE)}
_ANY = re.compile(b"|".join(re.escape(s) for s in SENTINELS.values()))
COLUMNS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(),
           "output": pa.string(), "output_sha256": pa.string()}


class PieceTable:
    """Descriptors (buffer, start, end) over byte buffers."""

    def __init__(self, pieces: list[tuple[bytes, int, int]]):
        self.pieces = pieces

    @classmethod
    def of(cls, buffer: bytes) -> PieceTable:
        return cls([(buffer, 0, len(buffer))])

    def cut(self, *places: int) -> list[PieceTable]:
        """Split at the byte offsets `places` (rising): one table per part."""
        parts, rest = [], list(self.pieces)
        at = 0
        for place in places:
            taken = []
            while rest and at + rest[0][2] - rest[0][1] <= place:
                taken.append(rest.pop(0))
                at += taken[-1][2] - taken[-1][1]
            if rest and at < place:
                buffer, start, end = rest[0]
                taken.append((buffer, start, start + place - at))
                rest[0] = (buffer, start + place - at, end)
                at = place
            parts.append(PieceTable(taken))
        return [*parts, PieceTable(rest)]

    def __add__(self, other: PieceTable) -> PieceTable:
        return PieceTable(self.pieces + other.pieces)

    def chunks(self) -> Iterator[memoryview]:
        for buffer, start, end in self.pieces:
            yield memoryview(buffer)[start:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for chunk in self.chunks():
            digest.update(chunk)
        return digest.hexdigest()

    def text(self) -> str:
        return b"".join(self.chunks()).decode()

    def n_chars(self) -> int:
        """Code points: bytes that do not continue one."""
        return sum(int(np.count_nonzero((np.frombuffer(c, np.uint8) & 0xC0) != 0x80)) for c in self.chunks())


def unit_bounds(data: bytes) -> np.ndarray:
    """Byte offsets at which the units of a text end, with 0 in front."""
    codes = np.frombuffer(data, np.uint8)
    word = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    ends = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    tail = [len(data)] if len(data) and not word[-1] else []
    return np.concatenate([[0], ends, tail]).astype(np.int64)


def draws(seed: int, doc) -> list[int]:
    """Four numbers below 2^32 from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def arrange(data: bytes, doc, seed: int, moved: int, spm: int):
    """(n, form, prefix, middle, output) of one text; prefix and middle are None for a plain one."""
    bounds = unit_bounds(data)
    n = len(bounds) - 1
    first, second, move, order = draws(seed, doc)
    whole = PieceTable.of(data)
    if not data or _ANY.search(data) or move % 100 >= moved:
        return n, "plain", None, None, whole
    form = "spm" if order % 100 < spm else "psm"
    ends = sorted((first % (n + 1), second % (n + 1)))
    parts = whole.cut(*(int(bounds[e]) for e in ends))
    output = PieceTable([])
    for sentinel, part in ORDERS[form]:
        output = output + PieceTable.of(SENTINELS[sentinel]) + parts[part]
    return n, form, parts[0], parts[1], output


def rebuild(data: bytes, form: str) -> PieceTable:
    """The document of an output: cut it at its sentinels, drop these, undo the order."""
    if form == "plain":
        return PieceTable.of(data)
    marks = [SENTINELS[s] for s, _ in ORDERS[form]]
    starts = [data.index(m) for m in marks]
    pieces = PieceTable.of(data).cut(*(p for at, m in zip(starts, marks) for p in (at, at + len(m))))
    found = {part: pieces[2 * k + 2] for k, (_, part) in enumerate(ORDERS[form])}
    return found[0] + found[1] + found[2]


def _replace(docs: DataFrame, columns: dict[str, pa.DataType]) -> tuple[list[str], str]:
    """The columns of `docs` that stay, and the schema with the new columns behind them."""
    kept = [c for c in docs.columns if c not in columns]
    kinds = {pa.int64(): "bigint", pa.string(): "string"}
    fields = [f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return kept, ", ".join([*fields, *(f"{c} {kinds[t]}" for c, t in columns.items())])


def fill_in_middle(docs: DataFrame, doc: str = "doc_id", text: str = "text", seed: int = SEED,
                   moved: int = MOVED_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """The rows with n (units), form, prefix_chars, middle_chars, output and output_sha256."""
    kept, schema = _replace(docs, COLUMNS)
    read = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("__text"), F.col(doc).cast("string").alias("__doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, name in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                n, form, prefix, middle, output = arrange((value.as_py() or "").encode(), name.as_py(), seed, moved, spm)
                rows.append((n, form, prefix.n_chars() if prefix else None, middle.n_chars() if middle else None,
                             output.text(), output.sha256()))
            columns = list(zip(*rows)) or [()] * len(COLUMNS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], *(pa.array(v, t) for v, t in zip(columns, COLUMNS.values()))], names=[*kept, *COLUMNS])

    return read.mapInArrow(run, schema)


def restore(moved: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows with restored and restored_sha256: the texts that `output` was made from."""
    added = {"restored": pa.string(), "restored_sha256": pa.string()}
    kept, schema = _replace(moved, added)
    read = moved.select(*[F.col(f"`{c}`") for c in kept], F.col(output).alias("__output"), F.col(form).alias("__form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digests = [], []
            for value, kind in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                table = rebuild((value.as_py() or "").encode(), kind.as_py())
                texts.append(table.text())
                digests.append(table.sha256())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(texts, pa.string()), pa.array(digests, pa.string())], names=[*kept, *added])

    return read.mapInArrow(run, schema)


def op12_fill_middle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    moved = fill_in_middle(docs).drop("text")
    return restore(moved).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


OP12_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
             CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM h),
e AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:], '') AS suf FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

QUERIES = {"op12_fill_middle": op12_fill_middle}
ORACLES = {"op12_fill_middle": OP12_SQL}
