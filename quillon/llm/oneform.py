"""Visually identical text with different characters (problem 5).

One form: full-width and half-width forms become the usual ones, compatibility ligatures and Roman
numerals their letters, non-breaking and other fixed-width spaces a plain space, the non-breaking
hyphen a hyphen; invisible characters go; look-alike Cyrillic and Greek letters become the Latin
letters they look like; and everything is composed (NFC). Case, accents, superscripts, fractions,
circled signs, quotation marks, line breaks and numbers of plain spaces stay as they are.

``unify`` is the engine: DuckDB inside Arrow partitions. ``one_form`` is the same rule for one
Python string, for operators that need the form of a text while they work on it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import parts

# Letters that look like a Latin letter, and that letter.
LOOK_ALIKE = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O",
}

# Characters that are not seen, as first and last code point of each run.
_INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
]
INVISIBLE = "".join(chr(x) for first, last in _INVISIBLE for x in range(first, last + 1))

# Spaces that look like a plain one (no-break, those of U+2000 to U+200A, narrow
# no-break, mathematical, ideographic), and hyphens that look like the plain one.
SPACES = "\u00a0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
HYPHENS = "\u2010\u2011"


def _compatible() -> dict[str, str]:
    """By rule: wide and narrow forms, and the compatibility ligatures and Roman numerals."""
    found = {}
    for code in (*range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)):
        kind, *rest = (unicodedata.decomposition(chr(code)) or "<none>").split()
        if kind in ("<wide>", "<narrow>", "<compat>"):
            found[chr(code)] = "".join(chr(int(x, 16)) for x in rest)
    # a long s within a ligature is one more compatibility form
    return {k: v.replace("ſ", "s") for k, v in found.items()}


def _accented() -> dict[str, str]:
    """By rule: composed look-alikes, where the accent on the Latin letter is a letter too."""
    found = {}
    for code in range(0x0370, 0x0530):
        two = unicodedata.normalize("NFD", chr(code))
        if len(two) > 1 and two[0] in LOOK_ALIKE:
            found[chr(code)] = unicodedata.normalize("NFC", LOOK_ALIKE[two[0]] + two[1:])
    return found


TABLE: dict[str, str] = (
    _accented() | _compatible() | LOOK_ALIKE | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(SPACES, " ") | dict.fromkeys(HYPHENS, "-")
)
_TRANSLATE = str.maketrans(TABLE)
_SOME = re.compile("[" + "".join(map(re.escape, TABLE)) + "]")


def one_form(text: str | None) -> str:
    """The one form of a string; null counts as the empty string."""
    if not text or text.isascii():
        return text or ""
    composed = unicodedata.normalize("NFC", text)
    # most texts of other letters hold none of the table
    return unicodedata.normalize("NFC", composed.translate(_TRANSLATE)) if _SOME.search(composed) else composed


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The same rule as an expression of DuckDB's SQL."""
    single = {k: v for k, v in TABLE.items() if len(v) == 1}
    several = {k: v for k, v in TABLE.items() if len(v) > 1}
    gone = "".join(k for k, v in TABLE.items() if not v)
    inner = f"regexp_replace(nfc_normalize({column}), '[{gone}]', '', 'g')"
    inner = f"translate({inner}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    # characters that become several are rare: they are replaced only where one occurs
    chained = inner
    for k, v in several.items():
        chained = f"replace({chained}, {_quoted(k)}, {_quoted(v)})"
    some = "[" + "".join(several) + "]"
    inner = f"CASE WHEN regexp_matches({column}, {_quoted(some)}) THEN {chained} ELSE {inner} END"
    return f"CASE WHEN strlen({column}) = length({column}) THEN {column} ELSE nfc_normalize({inner}) END"


def connection():
    """An in-process DuckDB of one thread and bounded memory."""
    import duckdb

    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    db.execute("SET preserve_insertion_order = true")
    return db


def unify(df: DataFrame, columns: list[str], suffix: str = "_form", digest: bool = False) -> DataFrame:
    """Adds, for each of the named string columns, its one form as ``<column><suffix>``.

    Null stays null and the empty string empty; a text of invisible characters only becomes empty.
    Other columns pass through unchanged, whatever their names; a column already named
    ``<column><suffix>`` is replaced. An empty table gives an empty result. Repeated rows
    stay repeated. Texts of any length are handled whole.

    With ``digest`` the text columns are replaced by MD5 digests of the form and of the string
    itself (``<column><suffix>``, ``<column>_raw``), so that comparisons need not carry texts.
    """
    added = [f"{c}{suffix}" for c in columns] + ([f"{c}_raw" for c in columns] if digest else [])
    keep = [c for c in df.columns if not (digest and c in columns) and c not in added]
    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    for name in added:
        schema = schema.add(name, "binary" if digest else "string")
    exprs = []
    for c in columns:
        form = form_sql("x")
        exprs.append((f"{c}{suffix}", f"unhex(md5({form}))" if digest else form, c))
        if digest:
            exprs.append((f"{c}_raw", "unhex(md5(x))", c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connection()
        try:
            for batch in batches:
                for part in parts(batch, *columns):
                    made = {}
                    for name, expr, source in exprs:
                        given = pa.table({"x": part.column(source).cast(pa.string())})
                        db.register("given", given)
                        out = db.sql(f"SELECT {expr} AS y FROM given").to_arrow_table().column("y").combine_chunks()
                        db.unregister("given")
                        kind = pa.binary() if digest else pa.string()
                        made[name] = (out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)).cast(kind)
                    fields = [part.column(i) for i, c in enumerate(part.schema.names) if c in keep]
                    names = [c for c in part.schema.names if c in keep]
                    order = names + added
                    arrays = fields + [made[n] for n in added]
                    yield pa.RecordBatch.from_arrays(arrays, names=order)
        finally:
            db.close()

    return df.mapInArrow(run, schema)


def same_looking_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Pairs of records whose value of a column looks the same and is not the same string:
    ``<key>_a, <key>_b, field`` with a < b.

    Values that are null or empty pair with nothing, nor does a null key; equal strings are no
    pair. Only digests travel. A group of one form is taken apart by its distinct strings: a record
    first meets the other strings of its form, then each of these its records, so equal strings are
    never compared with each other and the work follows the result.
    """
    src = df.select(F.col(key).cast("long").alias("id"), *[F.col(c) for c in columns]).where(F.col("id").isNotNull())
    # all columns in one pass: a record becomes a row for each of its values
    digests = unify(src, columns, digest=True)
    values = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_form").alias("form"), F.col(f"{c}_raw").alias("raw")) for c in columns])
    long = digests.select("id", F.explode(values).alias("v")).select("id", "v.field", "v.form", "v.raw")
    long = long.where(F.col("raw").isNotNull() & (F.col("raw") != F.unhex(F.lit(EMPTY_MD5))))
    strings = long.groupBy("field", "form", "raw").agg(F.lit(1).alias("one")).drop("one")
    mixed = strings.groupBy("field", "form").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    strings = strings.join(mixed, ["field", "form"], "left_semi")
    other = strings.withColumnRenamed("raw", "other")
    meets = strings.join(other, ["field", "form"]).where(F.col("raw") < F.col("other")).select("field", "raw", "other")
    a = long.select("field", "raw", F.col("id").alias("x"))
    b = long.select("field", F.col("raw").alias("other"), F.col("id").alias("y"))
    pairs = meets.join(a, ["field", "raw"]).join(b, ["field", "other"])
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "field").where(F.col(f"{key}_a") != F.col(f"{key}_b")).distinct()


EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
