"""Reading feedback: CSV files, bytes and DataFrames become string DataFrames with canonical column names."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernwell.functions.text import csv_null
from fernwell.sources.profile import CORE, CORE_SYNONYMS, Profile, normalize_header

ROW_NUMBER = re.compile(r"^(unnamed_\d+|index|)$")
ORDER = "__order"


class DataValidationError(ValueError):
    """Input that can't be analysed, with what to do about it."""


@dataclass
class CleaningReport:
    """What reading and cleaning changed."""

    rows_received: int = 0
    rows_retained: int = 0
    column_mapping: dict[str, str] = field(default_factory=dict)
    extra_columns: list[str] = field(default_factory=list)
    row_number_columns: list[str] = field(default_factory=list)
    missing_optional_columns: list[str] = field(default_factory=list)
    missing_values_before: dict[str, int] = field(default_factory=dict)
    removed: dict[str, int] = field(default_factory=dict)
    flagged: dict[str, int] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def rows_removed(self) -> int:
        return sum(self.removed.values())

    def summary_table(self, spark: SparkSession) -> DataFrame:
        rows = [("removed", k, v) for k, v in self.removed.items()] + [("flagged", k, v) for k, v in self.flagged.items()]
        return spark.createDataFrame(rows, "action string, reason string, rows long")


def sniff_encoding(head: bytes) -> str:
    """UTF-8 if the bytes are, Windows-1252 if those are, else Latin-1."""
    for name, spark_name in (("utf-8-sig", "UTF-8"), ("cp1252", "windows-1252")):
        try:
            head.decode(name)
            return spark_name
        except UnicodeDecodeError as e:
            if name == "utf-8-sig" and len(head) >= 65536 and len(head) - e.start < 4:
                return "UTF-8"  # a character cut at the end
    return "ISO-8859-1"


def _headers(line: list[str]) -> list[str]:
    """Blank headers get their place, repeated ones a count."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(line):
        h = h.strip() or f"Unnamed: {i}"
        n = seen.get(h, 0)
        seen[h] = n + 1
        out.append(f"{h}.{n}" if n else h)
    return out


HEAD_BYTES = 65536
#: Where Windows-1252 differs from Latin-1: the latter's control characters, and what the former has in their places.
_CONTROLS = "".join(chr(i) for i in range(128, 160) if bytes([i]).decode("cp1252", "ignore"))
_WINDOWS = _CONTROLS.encode("latin-1").decode("cp1252")


def read_head(spark: SparkSession, path: str, most: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of the first file of a folder that has any, by Spark's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in sorted(fs.globStatus(p) or [], key=lambda x: x.getPath().toString()):
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        for f in sorted(inside, key=lambda x: x.getPath().toString()):
            if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                stream = fs.open(f.getPath())
                try:
                    return bytes(stream.readNBytes(most))
                finally:
                    stream.close()
    return b""


def _read_path(spark: SparkSession, path: str, encoding: str, names: list[str], multi_line: bool) -> DataFrame:
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    one_byte = encoding != "UTF-8"
    df = spark.read.csv(path, schema=schema, header=True, multiLine=multi_line, quote='"', escape='"', ignoreLeadingWhiteSpace=True, encoding="ISO-8859-1" if one_byte else encoding, enforceSchema=True)
    if encoding == "windows-1252":  # the reader knows no such code page
        df = df.select([F.translate(c, _CONTROLS, _WINDOWS).alias(c) for c in df.columns])
    return df


def load_csv(spark: SparkSession, source: str | bytes | io.IOBase | DataFrame, max_rows: int | None = None, multi_line: bool = True) -> DataFrame:
    """A string DataFrame with an order column. Paths are read by Spark in parallel; bytes and files must fit the driver.

    A path's encoding is taken from its head; where that is UTF-8 but a later byte is not, the file is read as Windows-1252,
    as it is if given as bytes. ``multi_line=False`` lets Spark split files, where no quoted value holds a line feed.
    """
    if isinstance(source, DataFrame):
        df = source.select([F.col(f"`{c}`").cast("string").alias(c) for c in source.columns])
        return _guard(df, max_rows).withColumn(ORDER, F.monotonically_increasing_id())
    if isinstance(source, str):
        head = read_head(spark, source)
        if not head.strip():
            raise DataValidationError("The file is empty.")
        encoding = sniff_encoding(head)
        line = next(csv.reader(io.StringIO(head.decode({"UTF-8": "utf-8-sig", "windows-1252": "cp1252"}.get(encoding, "latin-1"), "replace")), skipinitialspace=True), [])
        names = _headers(line)
        df = _read_path(spark, source, encoding, names, multi_line)
        if encoding == "UTF-8" and not df.filter(reduce(lambda x, y: x | y, [F.coalesce(F.contains(F.col(c), F.lit("\ufffd")), F.lit(False)) for c in df.columns])).isEmpty():
            df = _read_path(spark, source, "windows-1252", names, multi_line)
        df = df.toDF(*names)
    else:
        data = source if isinstance(source, bytes) else source.read()
        if isinstance(data, str):
            data = data.encode()
        if not data.strip():
            raise DataValidationError("The file is empty.")
        encoding = {"UTF-8": "utf-8-sig", "windows-1252": "cp1252"}.get(sniff_encoding(data), "latin-1")
        rows = list(csv.reader(io.StringIO(data.decode(encoding)), skipinitialspace=True))
        names = _headers(rows[0])
        cells = [tuple((*r, *[None] * len(names))[: len(names)]) for r in rows[1:] if r]
        df = spark.createDataFrame(cells, ", ".join(f"`c{i}` string" for i in range(len(names)))).toDF(*names)
    df = df.select([csv_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _guard(df, max_rows).withColumn(ORDER, F.monotonically_increasing_id())


def _guard(df: DataFrame, max_rows: int | None) -> DataFrame:
    if not df.columns:
        raise DataValidationError("The file has no columns.")
    if df.isEmpty():
        raise DataValidationError("The file has no rows.")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise DataValidationError(f"The file has more than {max_rows:,} rows.")
    return df


def standardize_columns(df: DataFrame, report: CleaningReport, profile: Profile) -> DataFrame:
    """Rename to canonical names: profile map, canonical name, profile synonym, core synonym; a second claim is dropped."""
    own = {normalize_header(k): v for k, v in (profile.raw.get("columns") or {}).items()}
    synonyms = {normalize_header(k): v for k, v in (profile.raw.get("column_synonyms") or {}).items()}
    core = {s: target for target, names in CORE_SYNONYMS.items() for s in names}
    names = [c for c in df.columns if c != ORDER]
    normal = {c: normalize_header(c) for c in names}
    present, used, kept = set(normal.values()), set(), []
    canonical = {*CORE, *own.values(), *synonyms.values()}
    for c in names:
        n = normal[c]
        target = own.get(n) or n
        if target == n and n not in canonical:
            for table in (synonyms, core):
                if (t := table.get(n)) and t not in present and t not in used:
                    target = t
                    break
        if target in used:
            report.warnings.append(f"Column {c!r} was dropped: {target} is there already.")
            continue
        used.add(target)
        kept.append((c, target or n))
        if ROW_NUMBER.match(n):
            report.row_number_columns.append(target)
        if target != c:
            report.column_mapping[c] = target
    roles = profile.resolve_roles([t for _, t in kept])
    known = {*CORE, *roles.dimensions, *(n.column for n in roles.numeric), *(o.column for o in roles.outcomes)}
    report.extra_columns = [t for _, t in kept if t not in known and t not in report.row_number_columns]
    report.missing_optional_columns = [c for c in CORE if c != "review_text" and c not in used]
    return df.select(*[F.col(f"`{c}`").alias(t) for c, t in kept], ORDER)


def validate_schema(df: DataFrame) -> None:
    if "review_text" not in df.columns:
        raise DataValidationError("There must be a review_text column; found: " + ", ".join(c for c in df.columns if c != ORDER))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """A hand-label CSV: blanks stay empty strings and tokens such as N/A stay text."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
