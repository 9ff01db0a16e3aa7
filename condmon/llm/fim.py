"""Fill-in-the-middle transformation of whole texts.

Every text becomes an array of code points (UTF-32).  Each code point has a
class; comparing the classes of neighbours gives the places where a unit (a
line, a word, a character) ends, ``flatnonzero`` their list, and the two ranks
drawn for the row choose the ends of prefix and middle.  Only the pieces are
encoded again.

The draws are functions of the seed and the row's id, so a lost executor's rows
come out the same, and no row needs another one: there is no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condmon.llm.common import append_columns, text_bytes, without

_NEWLINE, _SPACES = 10, np.array([*range(9, 14), 32, 0x85, 0xA0], dtype="<u4")


def _line_ends(cp: np.ndarray) -> np.ndarray:
    """A unit ends after every newline."""
    return cp[:-1] == _NEWLINE


def _word_ends(cp: np.ndarray) -> np.ndarray:
    """A unit is a word with the blanks after it: it ends where a blank is followed by none."""
    blank = np.isin(cp, _SPACES)
    return blank[:-1] & ~blank[1:]


def _char_ends(cp: np.ndarray) -> np.ndarray:
    return np.ones(len(cp) - 1, dtype=bool)


#: Kinds of units: whether a unit ends between each two neighbours.
UNITS = {"lines": _line_ends, "words": _word_ends, "chars": _char_ends}


@dataclass(frozen=True)
class Settings:
    """``rate`` and ``spm`` are per cent of rows that are transformed, and of those in suffix-prefix-middle order."""

    units: str = "lines"
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if self.units not in UNITS:
            raise ValueError(f"units must be one of {sorted(UNITS)}")
        marks = self.marks
        if len(set(marks)) < 3 or not all(marks) or any(m[0] in other[1:] or (m != other and other.startswith(m)) for m in marks for other in marks):
            raise ValueError("marks must differ, and the first character of a mark may be in none but as its first")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def ends(cp: np.ndarray, units: str) -> np.ndarray:
    """Ends of the units of a code point array, from 0 (before the first one)."""
    if not len(cp):
        return np.zeros(1, dtype=np.int64)
    return np.concatenate([[0], np.flatnonzero(UNITS[units](cp)) + 1, [len(cp)]])


def pieces(text: bytes, units: str, first: int, second: int) -> tuple[int, bytes, bytes, bytes, int, int]:
    """Units of a text, its three pieces, and the code points of the first two; the cuts are the draws modulo units + 1."""
    cp = np.frombuffer(text.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    at = ends(cp, units)
    n = len(at) - 1
    i, j = (int(at[r]) for r in sorted((first % (n + 1), second % (n + 1))))
    cut = [p.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape") for p in (cp[:i], cp[i:j], cp[j:])]
    return n, *cut, i, j - i


def draws(id_col: Column, seed: int) -> list[Column]:
    """The four draws of a row: the first 8-digit groups of the SHA-256 of seed and id, as unsigned numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(df: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (code points, null if plain) and ``output``; the text itself goes.

    Plain rows are those with an empty or null text, with a text that holds one
    of the marks, and those not drawn; their output is the text (null: empty).
    A null id draws like an empty one, rows that share an id share their draws.
    Long texts are cut whole (four bytes a code point), one at a time.  Columns
    named like an output (ignoring case) are replaced; an empty table gives an
    empty one.  Bytes that are not UTF-8 are code points of their own and come
    back unchanged.
    """
    s = settings or Settings()
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    drawn = ["__first", "__second", "__form", "__order"]
    source = df if text_col not in names else df.withColumnRenamed(text_col, "__body")
    body = text_col if text_col not in names else "__body"
    rows = without(source, [c for c in names if c != id_col])
    rows = rows.withColumns(dict(zip(drawn, draws(F.col(f"`{id_col}`"), s.seed), strict=True)))
    p, m, x = (k.encode() for k in (s.prefix, s.middle, s.suffix))

    def make():
        def fn(part: pa.RecordBatch) -> list:
            text, offsets = text_bytes(part.column(part.schema.get_field_index("__text")))
            raw, off = text.tobytes(), offsets.tolist()
            first, second, third, fourth = (part.column(part.schema.get_field_index(c)).to_pylist() for c in drawn)
            out = []
            for k in range(part.num_rows):
                t = raw[off[k] : off[k + 1]]
                n, a, b, c, na, nb = pieces(t, s.units, first[k], second[k])
                if not t or third[k] % 100 >= s.rate or p in t or m in t or x in t:
                    out.append((n, "plain", None, None, t))
                elif fourth[k] % 100 < s.spm:
                    out.append((n, "spm", na, nb, b"".join((x, c, p, a, m, b))))
                else:
                    out.append((n, "psm", na, nb, b"".join((p, a, x, c, m, b))))
            return [list(col) for col in zip(*out, strict=True)]

        return fn

    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.BinaryType())]
    done = append_columns(rows, body, fields, make, keep_text=False)
    return done.drop(*drawn).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, settings: Settings | None = None) -> Column:
    """The exact text, from an output and its form alone."""
    s = settings or Settings()
    head, middle = F.substring_index(output, s.middle, 1), F.substring_index(output, s.middle, -1)

    def two(first: str, second: str) -> tuple[Column, Column]:
        return F.replace(F.substring_index(head, second, 1), F.lit(first), F.lit("")), F.substring_index(head, second, -1)

    prefix, suffix = two(s.prefix, s.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = two(s.suffix, s.prefix)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix))
