"""Text layouts of published tables: white-space and comma tables, ragged sample rows, key=value files, blocks, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions.ranks import numbered


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _six(number: Column) -> Column:
    """A number to six digits as text, whatever its spelling; null where it is none."""
    value = number.try_cast("double")
    return F.when(value.isNotNull(), F.format_string("%.6f", value))


def _content(spark: SparkSession, path: str) -> DataFrame:
    """``(value, at)``: the lines that hold something and are no comment; ``at`` orders them by the time their file was written, then by file and place.

    So a later append comes after all earlier ones; of one append's part files, the one that was written later.
    """
    place = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select("value", place.alias("at"))
    return lines.where(~F.col("value").rlike(r"^\s*(#|$)"))


def read_columns(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """White-space separated columns by position; lines of too few fields give nulls, as do fields that don't parse, further fields are ignored."""
    fields = _content(spark, path).select(_fields(F.col("value")).alias("f"))
    return fields.select(*[F.get("f", i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(schema.items())])


def write_columns(table: DataFrame, path: str, names: list[str], mode: str = "append") -> None:
    """White-space separated columns; a file with one ``#`` line of names goes before the first rows only, not with later appends; null is ``nan``."""
    spark = table.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if mode == "overwrite" or not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([("# " + " ".join(names),)], "value string").coalesce(1).write.mode(mode).text(path)
        mode = "append"
    line = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in names])
    table.select(line.alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def read_csv(spark: SparkSession, path: str, schema: dict[str, str], header: bool = True) -> DataFrame:
    """Comma tables under given names, blanks about a field left out; rows with a field that is missing or doesn't parse go."""
    text = ", ".join(f"`{name}` string" for name in schema)
    rows = spark.read.csv(path, schema=text, header=header, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    return rows.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in schema.items()]).dropna()


def read_samples(spark: SparkSession, path: str, keys: dict[str, str], keep: Column | None = None, sep: str = " ") -> DataFrame:
    """Ragged rows: the keys, then any number of values as array ``samples``; ``keep`` filters on the keys before values are parsed."""
    line = _content(spark, path).select(_fields(F.translate("value", sep, " ")).alias("f"))
    own = line.select("f", *[F.get("f", i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(keys.items())])
    own = own if keep is None else own.where(keep)
    rest = F.transform(F.slice("f", F.lit(len(keys) + 1), F.greatest(F.size("f") - len(keys), F.lit(0))), lambda v: v.try_cast("double"))
    return own.select(*keys, rest.alias("samples"))


def write_samples(table: DataFrame, path: str, keys: list[str], order: str, value: str, sep: str = " ", mode: str = "append") -> None:
    """A row a key: the keys, then its values in order, null ones as ``nan``. One row holds one grid point's samples, as the layout has it."""
    own = table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("own"))
    line = F.concat_ws(sep, *keys, F.transform("own", lambda x: F.coalesce(x[value].cast("string"), F.lit("nan"))))
    own.select(line.alias("value")).write.mode(mode).text(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """``(key, value, kind, items)`` of key=value lines; kind is int, float, bool, list or str by the literal, items the texts of a list's entries. Of a repeated key the last counts."""
    cut = F.split("value", "=", 2)
    rows = _content(spark, path).where(F.col("value").contains("=")).select(F.trim(cut[0]).alias("key"), F.trim(cut[1]).alias("value"), "at")
    last = rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    v = F.col("value")
    inner = F.trim(F.regexp_extract(v, r"^[\[(](.*)[\])]$", 1))
    items = F.when(v.rlike(r"^(\[.*\]|\(.*\))$"), F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"\s*,\s*")))
    kind = F.when(items.isNotNull(), "list").when(v.rlike(r"^[+-]?\d+$"), "int").when(v.try_cast("double").isNotNull(), "float").when(F.lower(v).isin("true", "false"), "bool").otherwise("str")
    return last.select("key", "value", kind.alias("kind"), items.alias("items"))


def write_parameters(table: DataFrame, path: str, key: str, value: str, mode: str = "overwrite") -> None:
    table.select(F.concat(F.col(key).cast("string"), F.lit("="), F.col(value).cast("string")).alias("value")).write.mode(mode).text(path)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """``(d, l, w, rho_key, tau)`` of a cache of autocorrelation times: finite positive ones only, the last of each key; rho to six digits."""
    lines = _content(spark, path).select(_fields(F.col("value")).alias("f"), "at")
    own = lines.select(*[F.get("f", i).try_cast("int").alias(c) for i, c in enumerate(("d", "l", "w"))], _six(F.get("f", F.lit(3))).alias("rho_key"), F.get("f", F.lit(4)).try_cast("double").alias("tau"), "at")
    good = own.where((F.col("tau") > 0) & (F.col("tau") < float("inf")) & F.col("rho_key").isNotNull())
    return good.groupBy("d", "l", "w", "rho_key").agg(F.max_by("tau", "at").alias("tau"))


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, r"\s+"), lambda v: v != ""), lambda v: v.try_cast("double"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(z, average, by_size, portion)`` of an ensemble's blocks, which an empty line ends.

    A block says ``Current Z = ..``, ``Average number of clusters: ..``, ``Average number of clusters by size: ..`` and ``Average portion of clusters by size: ..``; one without all
    four lines is left out, a number that doesn't parse is null. Records end at empty lines, so that Spark splits a large file between them; an empty line holds no blanks.
    """
    block = spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("b"))
    said = lambda name: F.regexp_extract("b", rf"(?m)^\s*{name}[ \t]*(.*)$", 1)
    names = [r"Current Z =", r"Average number of clusters:", r"Average number of clusters by size:", r"Average portion of clusters by size:"]
    whole = F.lit(True)
    for name in names:
        whole = whole & F.col("b").rlike(rf"(?m)^\s*{name}")
    z, average, by_size, portion = (said(name) for name in names)
    return block.where(whole).select(F.trim(z).try_cast("double").alias("z"), F.trim(average).try_cast("double").alias("average"), _numbers(by_size).alias("by_size"), _numbers(portion).alias("portion"))


def write_blocks(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Blocks of ``table(z, average, by_size, portion)`` as ``read_blocks`` reads them, five digits after the point; null numbers are ``nan``."""
    digits = lambda v: F.coalesce(F.format_string("%.5f", v.cast("double")), F.lit("nan"))
    listed = lambda c: F.concat_ws(" ", F.transform(c, digits))
    line = F.concat(
        F.lit("Current Z = "), digits(F.col("z")), F.lit("\nAverage number of clusters: "), digits(F.col("average")),
        F.lit("\nAverage number of clusters by size: "), listed("by_size"), F.lit("\nAverage portion of clusters by size: "), listed("portion"), F.lit("\n"),
    )
    table.select(line.alias("value")).write.mode(mode).text(path)


def read_configurations(spark: SparkSession, path: str) -> DataFrame:
    """``(z, t, graph, told, n, configuration)``: the canonical configurations of each graph, one row each, as arrays of rows of numbers.

    A record begins with ``Z = ..`` (its file may be split there), then come ``T = ..``, ``It is the ..nd graph ..``, ``Number of elements in canon_config: ..`` (told) and the matrices, an
    empty line after each. n counts from 0; a record without matrices has one row with null n and configuration. Text before the first record is left out.
    """
    record = spark.read.option("lineSep", "Z = ").text(path).select(F.col("value").alias("b")).where(F.col("b").rlike(r"^\S+\s*\n\s*T ="))
    one = lambda rule: F.regexp_extract("b", rule, 1)
    body = F.regexp_extract("b", r"canon_config:[^\n]*\n([\s\S]*)$", 1)
    matrices = F.filter(F.split(body, r"\n[ \t]*\n"), lambda m: F.trim(m).rlike(r"\S"))
    rows = lambda m: F.transform(F.filter(F.split(m, r"\n"), lambda r: r.rlike(r"\S")), lambda r: F.transform(_numbers(r), lambda v: v.cast("int")))
    head = record.select(
        one(r"^(\S+)").try_cast("double").alias("z"), one(r"T =[ \t]*(\S+)").try_cast("double").alias("t"), one(r"It is the[ \t]*(\d+)").try_cast("int").alias("graph"),
        one(r"canon_config:[ \t]*(\d+)").try_cast("long").alias("told"), matrices.alias("m"),
    )
    return head.select("z", "t", "graph", "told", F.posexplode_outer("m").alias("n", "text")).select("z", "t", "graph", "told", "n", rows(F.col("text")).alias("configuration"))


def write_configurations(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records of ``table(z, t, graph, n, configuration)`` as ``read_configurations`` reads them, configurations in order of n; a record holds one graph's, as the layout has it."""
    matrix = lambda c: F.array_join(F.transform(c["configuration"], lambda r: F.concat_ws(" ", F.transform(r, lambda v: v.cast("string")))), "\n")
    own = table.groupBy("z", "t", "graph").agg(F.sort_array(F.collect_list(F.struct("n", "configuration"))).alias("own"))
    line = F.concat(
        F.lit("Z = "), F.col("z").cast("string"), F.lit("\nT = "), F.col("t").cast("string"), F.lit("\nIt is the "), F.col("graph").cast("string"), F.lit("nd graph with scale = "), F.size("own").cast("string"),
        F.lit("\nNumber of elements in canon_config: "), F.size("own").cast("string"), F.lit("\n"), F.array_join(F.transform("own", lambda c: F.concat(matrix(c), F.lit("\n\n"))), ""),
    )
    own.select(line.alias("value")).write.mode(mode).text(path)


def read_couplings(spark: SparkSession, path: str, length: int) -> DataFrame:
    """``(site, field, coupling, nb)`` of block couplings: line i holds the field of block i and its couplings up, right, down and left, on a lattice of ``length`` squared blocks with periodic sides.

    One row a coupling; ``site`` is the number of the line among those that hold something, from 0, in order of files and places in them; lines after the last block are left out.
    Splits of a file number their lines side by side.
    """
    place = F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(F.col("value").alias("line"), place.alias("at")).where(F.col("line").rlike(r"\S"))
    lines = numbered(lines, [], ["at"], "site").where(F.col("site") < length * length)
    row, column = F.expr(f"site div {length}"), F.col("site") % length
    at = lambda r, c: (F.pmod(r, F.lit(length)) * length + F.pmod(c, F.lit(length))).cast("long")
    near = F.array(at(row - 1, column), at(row, column + 1), at(row + 1, column), at(row, column - 1))
    own = lines.select(F.col("site").cast("long").alias("site"), _numbers(F.col("line")).alias("f"), near.alias("near"))
    return own.select("site", F.get("f", F.lit(0)).alias("field"), F.explode(F.arrays_zip(F.slice("f", 2, 4).alias("coupling"), F.col("near").alias("nb"))).alias("x")).select("site", "field", "x.coupling", "x.nb")


def coupled_energy(couplings: DataFrame, spins: DataFrame) -> DataFrame:
    """``(energy)``: minus each block's field times its spin, minus half of each listed coupling times both spins, as both ends list it; missing numbers count nothing.

    ``spins(site, s)`` has a row a block.
    """
    both = couplings.join(spins, "site").join(spins.select(F.col("site").alias("nb"), F.col("s").alias("s2")), "nb")
    fields = couplings.select("site", "field").distinct().join(spins, "site").agg((-F.coalesce(F.sum(F.col("field") * F.col("s")), F.lit(0.0))).alias("own"))
    return both.agg((-F.coalesce(F.sum(0.5 * F.col("coupling") * F.col("s") * F.col("s2")), F.lit(0.0))).alias("between")).join(fields).select((F.col("own") + F.col("between")).alias("energy"))


def with_path_parameters(table: DataFrame, names: list[str], source: str = "path") -> DataFrame:
    """A column for each ``name=value`` in the path; ``rho`` to six digits whatever its spelling."""
    for name in names:
        found = F.regexp_extract(source, rf"(?:^|[/\-]){name}=([^/\-]+?)(?:\.txt|[/\-]|$)", 1)
        table = table.withColumn(name, _six(found) if name == "rho" else F.nullif(found, F.lit("")))
    return table


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """``(x, y, occ)`` of one matrix of numbers as text, one row a line; y counts the lines of the file, which is read whole (one lattice)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("y", "line"))
    return rows.select("y", F.posexplode(_fields(F.col("line"))).alias("x", "v")).select("x", "y", F.col("v").try_cast("int").alias("occ"))
