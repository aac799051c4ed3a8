"""Nominal instances: the data model of the Bayes side.

A :class:`NominalData` is a DataFrame with one row per instance — ``rid`` (long), one
int column per attribute holding a 0-based category code, ``cls`` (int class code)
and an optional double ``weight`` — plus the declared attribute cardinalities.

Readers / writers here: IO-1 nominal text scan, IO-2 domain scan, IO-11 file-range
selection, IO-12 synthetic binary instances, P-1 / P-2 missing-value rules.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.functions.hashing import h

# Default field separator of the nominal text format (fixed value).
DEFAULT_SPLIT_PATTERN = r"[ ,\t]*[,|\t][ ,\t]*"


@dataclass(frozen=True)
class NominalData:
    df: DataFrame
    attrs: tuple[str, ...]
    cards: tuple[int, ...]
    n_classes: int
    rid: str = "rid"
    cls: str = "cls"
    weight: str | None = None

    @property
    def d(self) -> int:
        return len(self.attrs)

    def w(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)

    def with_df(self, df: DataFrame) -> "NominalData":
        return replace(self, df=df)

    def x(self, i: int) -> Column:
        return F.col(self.attrs[i])


def domain_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """IO-2: (att, name, value, code) for every attribute, codes 0-based in sort order."""
    pairs = F.array(*[F.struct(F.lit(i).alias("att"), F.lit(c).alias("name"),
                               F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    dist = df.select(F.inline(pairs)).distinct()
    w = Window.partitionBy("att").orderBy("value")
    return dist.select("att", "name", "value", (F.dense_rank().over(w) - 1).cast("int").alias("code"))


def domain_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """IO-2 for domains of any size: as :func:`domain_table`, but no attribute's values are ranked
    by one task."""
    from kestrel.operators.ranks import dense_ranks

    pairs = F.array(*[F.struct(F.lit(i).alias("att"), F.lit(c).alias("name"),
                               F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return dense_ranks(df.select(F.inline(pairs)).distinct(), ["att", "name"], "value", "code")


def cardinalities(domain: DataFrame) -> DataFrame:
    """(att, name, card) from a domain table."""
    return domain.groupBy("att", "name").agg(F.count(F.lit(1)).cast("int").alias("card"))


def infer_cards(data: NominalData) -> NominalData:
    """Cardinalities from the data when they are not declared: max(code)+1 (one agg)."""
    row = data.df.agg(*[F.max(a).alias(a) for a in data.attrs], F.max(data.cls).alias("_k")).first()
    return replace(data, cards=tuple(int(row[a]) + 1 for a in data.attrs), n_classes=int(row["_k"]) + 1)


# -------------------------------------------------------------------- IO-1 text scan
def to_nominal_text(data: NominalData, sep: str = ",") -> DataFrame:
    """(rid, line): the codes joined by ``sep``, class last."""
    return data.df.select(data.rid, F.concat_ws(sep, *[F.col(a).cast("string") for a in data.attrs],
                                                F.col(data.cls).cast("string")).alias("line"))


def parse_nominal_text(lines: DataFrame, n_attrs: int, *, line_col: str = "line",
                       pattern: str = DEFAULT_SPLIT_PATTERN, keep: tuple[str, ...] = ()) -> DataFrame:
    """IO-1: split each line by ``pattern`` (trailing empties dropped, as Java's split),
    parse integer codes; the last field is the class -> (keep..., a0..a{n-1}, cls).

    A blank field, a non-integer field or a wrong field count fails the job (P-2),
    where the reference would silently shift columns.
    """
    n = n_attrs + 1
    out = lines.select(*keep, F.split(F.col(line_col), pattern, 0).alias("_p"))
    arity_ok = F.when(F.size("_p") == n, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("nominal row has wrong arity: "), F.size("_p").cast("string"))))
    fields = []
    for i in range(n):
        raw = F.trim(F.col("_p")[i])
        val = F.expr(f"try_cast(trim(_p[{i}]) AS INT)")
        fields.append(F.when(raw == "", F.raise_error(F.lit("missing value is unsupported")))
                      .when(val.isNull(), F.raise_error(F.concat(F.lit("not an integer code: "), raw)))
                      .otherwise(val).alias(f"a{i}" if i < n_attrs else "cls"))
    return out.where(arity_ok).select(*keep, *fields)


#: bits of a row id that hold the line number
LINE_BITS = 40


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_no, line_no, rid, line): every line with its place, whatever the input splits are.

    The lines are written once, with the split that they come from and their place in the task that read
    it.  A split is read by one task in order, so its lines stand at consecutive places from the split's smallest
    on; running sums of the splits' lines (one row a split) move the numbers on.  Every reader of the
    result thus sees one set of splits.  ``file_no`` numbers the files by name, ``rid`` holds file and line number."""
    from kestrel.sources.model_io import scratch_path

    # a line that a split takes over from the one before still carries its own split's start
    text = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                        F.monotonically_increasing_id().alias("place"))
    written = scratch_path(spark, "lines")
    text.write.parquet(written)
    text = spark.read.schema(text.schema).parquet(written)
    counts = text.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    names = counts.select("file").distinct()
    files = names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("file_no"))
    offsets = counts.select("file", "start", (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("first")).alias("before")).join(files, "file")
    # one row a split, fewer than the tasks that the driver plans: lines are not shuffled
    lines = text.join(F.broadcast(offsets), ["file", "start"])
    line_no = F.col("place") + F.col("before")
    rid = F.shiftleft(F.col("file_no").cast("bigint"), LINE_BITS).bitwiseOR(line_no)
    return lines.select("file", F.col("file_no").cast("bigint"), line_no.alias("line_no"), rid.alias("rid"), "line")


def distinct_ids(df: DataFrame, group: str, id_col: str, largest: str) -> DataFrame:
    """(group, n, ids, last): rows, different ids and the largest ``largest`` of each group, exact.  64
    neighbouring ids share a word of bits, so partial sums hold a record for 64 ids that run on, not
    one an id.  A null id is no id."""
    rid = F.col(id_col)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), rid.bitwiseAND(F.lit(63)).cast("int"))
    words = df.groupBy(group, F.shiftright(rid, 6).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("_bits"), F.max(largest).alias("last"))
    return words.groupBy(group).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0)).alias("ids"), F.max("last").alias("last"))


def read_nominal_text(spark: SparkSession, path: str, cards: tuple[int, ...], n_classes: int,
                      pattern: str = DEFAULT_SPLIT_PATTERN) -> NominalData:
    """IO-1 on files: numbered lines -> parsed rows.  Blank lines are skipped but counted; the row
    id is the place of the line, so folds and noise, which order by it, do not change with
    the input splits."""
    lines = numbered_lines(spark, path).where(F.length(F.trim("line")) > 0)
    parsed = parse_nominal_text(lines, len(cards), pattern=pattern, keep=("rid",))
    attrs = tuple(f"a{i}" for i in range(len(cards)))
    return NominalData(parsed.select("rid", *attrs, "cls"), attrs, tuple(cards), n_classes)


# ----------------------------------------------------------- P-1 / P-2 missing values
def drop_missing_class(data: NominalData) -> NominalData:
    """P-1."""
    return data.with_df(data.df.where(F.col(data.cls).isNotNull()))


def reject_missing(data: NominalData, on_missing: str = "error") -> NominalData:
    """P-2: the distributed counter does not accept missing attribute values.

    ``error`` fails the job at the first NULL; ``drop`` removes such rows.
    """
    any_null = F.lit(False)
    for a in data.attrs:
        any_null = any_null | F.col(a).isNull()
    if on_missing == "drop":
        return data.with_df(data.df.where(~any_null))
    if on_missing != "error":
        raise ValueError("on_missing must be 'error' or 'drop'")
    # in a filter, which no column pruning removes
    return data.with_df(data.df.where(F.when(any_null, F.raise_error(F.lit("missing value is unsupported"))).otherwise(True)))


# ----------------------------------------------------------------- IO-12 synthetic rows
def synth_binary(keys: DataFrame, key: str, n_attrs: int, seed: int = 0) -> NominalData:
    """IO-12: ``n_attrs`` uniform binary attributes plus a binary class for every key
    row of ``keys`` (md5-seeded, so the rows are reproducible in any SQL engine)."""
    cols = [(F.conv(F.substring(h(seed, F.col(key), j), 1, 1), 16, 10).cast("int") % 2).alias(f"a{j}")
            for j in range(n_attrs)]
    cls = (F.conv(F.substring(h(seed, F.col(key), "c"), 1, 1), 16, 10).cast("int") % 2).alias("cls")
    df = keys.select(F.col(key).cast("long").alias("rid"), *cols, cls)
    return NominalData(df, tuple(f"a{j}" for j in range(n_attrs)), (2,) * n_attrs, 2)


# ------------------------------------------------------------- IO-11 file-name range
def in_name_range(names: list[str], begin: str | None = None, end: str | None = None) -> list[str]:
    """IO-11: the data set names with, case-insensitively, ``begin <= name < end``."""
    return [n for n in names if (begin is None or n.lower() >= begin.lower()) and (end is None or n.lower() < end.lower())]
