"""Fill-in-middle transformation: texts cut into prefix, middle and suffix at whole units and put in another order.

Cuts go by a sparse index of checkpoints: while the units of a text (lines, words or characters) are counted, the byte
and code-point places of every 64th unit's start are recorded. A cut is found by binary search among these, then by
reading on from the checkpoint before it. So a text needs one pass and a few numbers a thousand units, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.arrays import raw_bytes
from lumenframe.llm.common import table

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are read at once.
BLOCK = 1 << 20


def unit_starts(data: np.ndarray, a: int, b: int, unit: str) -> np.ndarray:
    """Places from a to b (excluded) where units begin. Words have the white space after them, the first one also that before."""
    here = data[a:b]
    if unit == "char":
        flag = (here & 0xC0) != 0x80
    else:
        before = data[a - 1 : b - 1] if a else np.append(np.uint8(10), here[:-1])
        flag = before == 10 if unit == "line" else _SPACE[before] & ~_SPACE[here]
    at = np.flatnonzero(flag) + a
    if not a and b and unit == "word":
        first = at[:1].copy()
        at = np.append(0, at[1:] if len(first) else at)
    return at


def code_points(data: np.ndarray, a: int, b: int) -> int:
    return int(np.count_nonzero((data[a:b] & 0xC0) != 0x80))


class Checkpoints:
    """Byte and code-point places of every `every`-th unit of one text in UTF-8; n: its units."""

    def __init__(self, data: np.ndarray, unit: str = "line", every: int = 64):
        if unit not in ("line", "word", "char"):
            raise ValueError("units are lines, words or characters")
        self.data, self.unit, self.every = data, unit, every
        self.n, self.points, at, cp = 0, 0, [], []
        for a in range(0, len(data), BLOCK):
            b = min(len(data), a + BLOCK)
            starts = unit_starts(data, a, b, unit)
            kept = starts[-self.n % every :: every]
            leading = np.append(0, np.cumsum((data[a:b] & 0xC0) != 0x80))
            at.append(kept)
            cp.append(self.points + leading[kept - a])
            self.n += len(starts)
            self.points += int(leading[-1])
        self.bytes = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.chars = np.concatenate(cp) if cp else np.zeros(0, np.int64)
        self.units = np.arange(len(self.bytes)) * every

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point place where this unit begins; the ends of the text for the unit after the last."""
        if unit >= self.n:
            return len(self.data), self.points
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        a, left, step = int(self.bytes[k]), unit - int(self.units[k]), 256
        place = a
        while True:
            starts = unit_starts(self.data, place, min(len(self.data), place + step), self.unit)
            if left < len(starts):
                at = int(starts[left])
                return at, int(self.chars[k]) + code_points(self.data, a, at)
            left, place, step = left - len(starts), place + step, min(step * 4, BLOCK)


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be found again unambiguously: no mark is empty, holds another or begins as another one (or itself) ends."""
    for i, s in enumerate(marks):
        for j, t in enumerate(marks):
            if not s or (i != j and s in t) or any(s.endswith(t[:n]) for n in range(1, len(t) if i == j else len(t) + 1)):
                raise ValueError("marks must not be empty, hold or overlap each other")


def draws(seed: int, doc_id) -> list[int]:
    """Four unsigned 32-bit numbers: the first four groups of eight digits of sha256('seed:id'). A null id is written as nothing."""
    d = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(d[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(data: np.ndarray, h: list[int], unit: str, marks: tuple[bytes, bytes, bytes], rate: int, spm: int, every: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle, and output of one text."""
    text = data.tobytes()
    index = Checkpoints(data, unit, every)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return index.n, "plain", None, None, text
    first, second = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    (a, ca), (b, cb) = index.cut(first), index.cut(second)
    p, s, m = marks
    form = "spm" if h[3] % 100 < spm else "psm"
    out = s + text[b:] + p + text[:a] + m + text[a:b] if form == "spm" else p + text[:a] + s + text[b:] + m + text[a:b]
    return index.n, form, ca, cb - ca, out


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text", every: int = 64) -> DataFrame:
    """One row per row of docs: id, n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars, output.

    rate: per cent of texts that are transformed; spm: per cent of these with the suffix first. Both and the cuts go by the
    seed and the id alone, so reruns and rows that repeat an id agree. Plain texts (also empty ones and those that hold a
    mark) stay as they are, with null for the sizes. A null text counts as empty, a null id as an id of no digits. An empty
    table gives an empty result. Other columns aren't read.
    """
    check_marks(marks)
    coded = tuple(m.encode() for m in marks)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = next(f.dataType.simpleString() for f in docs.schema.fields if f.name == "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column("text"))
            ids = batch.column("id")
            size = max(1, BLOCK * 8)
            edges = np.flatnonzero(np.diff(at[:-1] // size, prepend=-1)).tolist() if len(ids) else []
            for i, j in zip(edges, [*edges[1:], len(ids)], strict=True):  # results of a few megabytes at once
                rows = [transform(data[at[k] : at[k + 1]], draws(seed, ids[k].as_py()), unit, coded, rate, spm, every) for k in range(i, j)]
                n, form, p, m, out = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.mapInArrow(cut, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of fill_in_middle() was made of."""
    p, s, m = marks

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(output, two, 1)
        rest = F.substr(output, F.length(head) + F.lit(len(two) + 1))
        body = F.substring_index(rest, m, 1)
        return F.substr(head, F.lit(len(one) + 1)), body, F.substr(rest, F.length(body) + F.lit(len(m) + 1)) if two == s else F.lit("")

    prefix, suffix, middle = parts(p, s)
    last, first, _ = parts(s, p)
    tail = F.substr(output, F.length(F.substring_index(output, m, 1)) + F.lit(len(m) + 1))
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, tail, last)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    text = restored(F.col("output"), F.col("form"))
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(text.cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, [('0x' || substr(h, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS r FROM d
), c AS (
  SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
