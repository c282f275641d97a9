"""File sources and sinks: ASCII grids as a Python data source, number matrices, namelists and chunked outputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from gridbrook.operators.grid import GridSpec
from gridbrook.operators.tables import save

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")


def _lines(path: str, start: int = 0):
    """Lines of a file in any store that ``pyarrow.fs`` knows, from a byte on, each with the byte where it starts."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))
    with fs.open_input_file(at) as f:
        f.seek(start)
        rest, place = b"", start
        while block := f.read(1 << 20):
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield place, line.decode("utf-8")
                place += len(line) + 1
        if rest:
            yield place, rest.decode("utf-8")


def read_header(path: str) -> tuple[dict, int]:
    """Values of an ASCII grid's header, and the byte where its rows start."""
    out, at = {}, 0
    for at, line in _lines(path):
        word = line.split()
        if not word or word[0].lower() not in HEADER:
            break
        out[word[0].lower()] = float(word[1])
    missing = {"ncols", "nrows", "xllcorner", "yllcorner", "cellsize"} - set(out)
    if missing:
        raise ValueError(f"{path}: header lacks {sorted(missing)}")
    return out, at


def grid_spec(path: str, spherical: bool = False) -> GridSpec:
    head, _ = read_header(path)
    return GridSpec(int(head["ncols"]), int(head["nrows"]), head["xllcorner"], head["yllcorner"], head["cellsize"], spherical, top_down=True)


class _Rows(InputPartition):
    def __init__(self, first: int, last: int, at: int):
        self.first, self.last, self.at = first, last, at


class AsciiGridReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rowsperpartition", 1000))

    def partitions(self):
        """Row ranges with the bytes where they start, found by one pass over the line ends; ``read_ascii_grid`` needs none."""
        head, start = read_header(self.path)
        rows = int(head["nrows"])
        if rows <= self.size:
            return [_Rows(0, rows, start)]
        places = [at for k, (at, _) in enumerate(_lines(self.path, start)) if k < rows and k % self.size == 0]
        return [_Rows(k * self.size, min(rows, (k + 1) * self.size), at) for k, at in enumerate(places)]

    def read(self, partition):
        missing = read_header(self.path)[0].get("nodata_value", -9999.0)
        for j, (_, line) in zip(range(partition.first, partition.last), _lines(self.path, partition.at)):
            for i, word in enumerate(line.split(), 1):
                if float(word) != missing:
                    yield i, j + 1, float(word)


class AsciiGrid(DataSource):
    """format("asciigrid"): (i, j, value) of the active cells, j from the top; row ranges are read in parallel."""

    @classmethod
    def name(cls):
        return "asciigrid"

    def schema(self):
        return "i int, j int, value double"

    def reader(self, schema):
        return AsciiGridReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AsciiGrid)


def write_ascii_grid(cells: DataFrame, spec: GridSpec, path: str, missing: float = -9999.0, value: str = "value") -> None:
    """Write active cells as an ASCII grid; rows are made in parallel and reach the driver one partition at a time."""
    rows = cells.groupBy("j").agg(F.map_from_entries(F.collect_list(F.struct("i", value))).alias("m"))
    j = F.col("j") if spec.top_down else spec.ny + 1 - F.col("j")
    every = cells.sparkSession.range(1, spec.ny + 1).select(F.col("id").cast("int").alias("j")).join(rows, "j", "left")
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(spec.nx)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(missing)).cast("string")), " ")
    with open(path, "w") as f:
        f.write(f"ncols {spec.nx}\nnrows {spec.ny}\nxllcorner {spec.xll}\nyllcorner {spec.yll}\ncellsize {spec.cellsize}\nNODATA_value {missing}\n")
        for row in every.select(j.alias("at"), line.alias("line")).orderBy("at").toLocalIterator():
            f.write(row["line"] + "\n")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file, or of a folder's files in the order of their names, that aren't blank, numbered from 1.

    Blocks are read in parallel and saved once with the places of their lines; each one's lines are counted, and the
    counts (a row a block) give the number of its first line.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    # a block is read from start to end by one task, so its lines have consecutive ids
    lines = save(spark.read.text(path).where(F.trim("value") != "").select(*block, F.monotonically_increasing_id().alias("id"), "value"), "lines")
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(F.broadcast(starts), ["file", "block"]).select((F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def load_text(spark: SparkSession, path: str, skip: int = 0, rows: int | None = None) -> DataFrame:
    """(row, v): a matrix of numbers separated by white space, rows from 1 in the order of the file, blank lines left out."""
    out = numbered_lines(spark, path).select((F.col("line") - skip).alias("row"), F.split(F.trim("value"), r"\s+").alias("w")).where("row > 0")
    if rows is not None:
        out = out.where(F.col("row") <= rows)
    return out.select("row", F.transform("w", lambda x: x.cast("double")).alias("v"))


def read_ascii_grid(spark: SparkSession, path: str, spherical: bool = False) -> tuple[DataFrame, GridSpec]:
    """(i, j, value) of the active cells and the grid, from any store that Spark reads; blocks of the file in parallel."""
    lines = numbered_lines(spark, path)
    head = {}
    for row in lines.where("line <= 6").orderBy("line").collect():
        word = row["value"].split()
        if word[0].lower() in HEADER:
            head[word[0].lower()] = float(word[1])
    missing = {"ncols", "nrows", "xllcorner", "yllcorner", "cellsize"} - set(head)
    if missing:
        raise ValueError(f"{path}: header lacks {sorted(missing)}")
    spec = GridSpec(int(head["ncols"]), int(head["nrows"]), head["xllcorner"], head["yllcorner"], head["cellsize"], spherical, top_down=True)
    rows = lines.where(F.col("line") > len(head)).select((F.col("line") - len(head)).cast("int").alias("j"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("k", "w"))
    value = F.col("w").cast("double")
    return rows.select((F.col("k") + 1).alias("i"), "j", value.alias("value")).where(F.col("value") != head.get("nodata_value", -9999.0)), spec


def write_text(df: DataFrame, row: str, v: str, path: str) -> None:
    """A matrix of numbers as text, a folder of parts in the order of the rows."""
    df.repartitionByRange(row).sortWithinPartitions(row).select(F.array_join(F.transform(v, lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def shape(spark: SparkSession, path: str) -> tuple[int, int]:
    found = spark.read.text(path).where(F.trim("value") != "").agg(F.count(F.lit(1)), F.max(F.size(F.split(F.trim("value"), r"\s+")))).first()
    return found[0], found[1] or 0


def read_namelist(text: str) -> dict[str, dict]:
    """Groups of a namelist: names to numbers, booleans, strings or lists of them."""
    def one(word: str):
        word = word.strip()
        if word[:1] in "'\"":
            return word[1:-1]
        if re.fullmatch(r"\.?(t|true|f|false)\.?", word, re.I):
            return word.strip(".").lower().startswith("t")
        try:
            return int(word)
        except ValueError:
            return float(word.lower().replace("d", "e"))

    out: dict[str, dict] = {}
    bare = "\n".join(re.sub(r"!.*", "", x) for x in text.splitlines())
    for name, body in re.findall(r"&(\w+)(.*?)\n\s*/", bare, re.S):
        group = out.setdefault(name.lower(), {})
        for key, value in re.findall(r"(\w+)\s*=\s*(.*?)(?=\s*\w+\s*=|\Z)", body, re.S):
            words = [w for w in re.split(r"[,\n]", value) if w.strip()]
            group[key.lower()] = one(words[0]) if len(words) == 1 else [one(w) for w in words]
    return out


def accumulate(updates: DataFrame, keys: list[str], ts: str, step: str, values: dict[str, str]) -> DataFrame:
    """Output steps from updates: each variable's sum, or mean, over the interval ``step`` for each of ``keys``."""
    how = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    return updates.groupBy(*keys, F.window(ts, step).alias("w")).agg(*(how[h](v).alias(v) for v, h in values.items())).select(*keys, F.col("w.start").alias("lower"), F.col("w.end").alias("upper"), *values)


def write_steps(df: DataFrame, path: str, ts: str = "upper") -> None:
    """Parquet by day, so that a window of time prunes folders."""
    df.withColumn("day", F.to_date(ts)).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)
