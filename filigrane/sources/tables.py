"""Tables of the engine: schemas, scans, appends, keyed overwrites, bundles and filings."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "report_data": "cik long, year int, url string",
    "names": "cik long, name string",
    "webpage_result": "url string, matches string",
    "server_result": "url string, server_response string",
    "fail_results": "cik long, year int, url string, reason string",
    "keyword_flags": "cik long, year int, user int, fx_user int, ir_user int, cp_user int",
}
#: The annual report forms.
FORMS = ("10-K", "10-KT", "20-F", "40-F", "10-K405", "10KSB", "10KSB40")
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


def create(spark: SparkSession, folder: str, tables: dict[str, str] = SCHEMAS) -> None:
    """Empty tables where none exist."""
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def valid_reports(reports: DataFrame, valid: bool = True) -> DataFrame:
    """Reports with a url, or the placeholders without one. The filter reaches the scan."""
    return reports.where((F.col("url") != "") if valid else (F.col("url") == ""))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header; the fallback where the file doesn't exist. A missing required column raises."""
    if not exists(spark, path):
        if fallback is None:
            raise FileNotFoundError(path)
        return fallback
    head = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in head]:
        raise ValueError(f"{path} lacks {missing}")
    return spark.read.option("header", True).schema(schema).csv(path)


def append(df: DataFrame, folder: str, table: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{table}")


def clean_names(names: DataFrame) -> DataFrame:
    """Distinct names without nulls, in title case."""
    return names.na.drop().select("cik", F.initcap("name").alias("name")).dropDuplicates()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, the last of each key by order; at equal order the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key the old table lacks."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def accepted(results: DataFrame, column: str, schema: str, reports: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose JSON column is of the schema, failures to add): a failure is (cik, year, url, reason) of a report, for bad rows whose url has none yet."""
    raw = F.col(column)
    reason = F.when(raw.isNull() | (F.trim(raw) == ""), "no response").when(F.from_json(raw, schema).isNull(), "not valid JSON").when(F.size(F.from_json(raw, schema)) == 0, "no predictions")
    judged = results.withColumn("reason", reason)
    bad = judged.where("reason IS NOT NULL").groupBy("url").agg(F.min("reason").alias("reason"))
    failed = bad.join(reports.select("cik", "year", "url").dropDuplicates(["url"]), "url").select("cik", "year", "url", "reason")
    return judged.where("reason IS NULL").drop("reason"), insert_missing(known, failed, ["url"])


def update(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of changes replaced where a key matches; a key given twice in changes is an error of the caller."""
    new = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = df.join(renamed, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def copy(df: DataFrame, folder: str, table: str) -> None:
    """The table replaced by df, which must not read it."""
    df.write.mode("overwrite").parquet(f"{folder}/{table}")


def text_lines(rows: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """Rows as tab-separated lines for a text sink; tabs and line breaks inside a value become spaces."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit("")) for c in columns]
    out = rows.select(F.concat_ws("\t", *cells).alias("value"))
    return out.limit(n) if n is not None else out


FILE_ROWS = 1_000_000


def write_by(rows: DataFrame, folder: str, column: str, file_rows: int = FILE_ROWS) -> None:
    """One Parquet folder a value. Rows of a value are brought together in tasks of about file_rows; a frequent value takes several."""
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.ceil(F.count("*") / file_rows).cast("int").alias("_files"))
    sized = rows.join(F.broadcast(counts), rows[column].eqNullSafe(F.col("_v")), "left")  # one row a folder
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != column] or [column]), F.coalesce("_files", F.lit(1))))
    salted.repartition(column, "_salt").select(*rows.columns).write.mode("overwrite").partitionBy(column).parquet(folder)


def write_bundle(bundle: dict[str, DataFrame], folder: str) -> None:
    """One Parquet folder a frame, named as a sheet would be; empty names are refused."""
    for name, df in bundle.items():
        safe = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31]
        if not safe:
            raise ValueError("a frame needs a name")
        df.write.mode("overwrite").parquet(f"{folder}/{safe}")


def execute(spark: SparkSession, sql: str, head: int = 0) -> DataFrame:
    out = spark.sql(sql)
    return out.limit(head) if head else out


def case_lines(rows: DataFrame, number: str, sentence: str, label: str) -> DataFrame:
    """A line of markup a row, for text export; the sentence's markup signs are escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit('<case num="'), F.col(number).cast("string"), F.lit('"><sentence>'), esc(F.col(sentence)), F.lit("</sentence><label>"), F.col(label).cast("string"), F.lit("</label></case>")).alias("value"))


def accession_url(cik: Column, accession: Column, document: Column) -> Column:
    """The archive url of a filing; a missing or text document has the accession number's name."""
    plain = F.replace(accession, F.lit("-"), F.lit(""))
    text = F.concat(F.substring(plain, 1, 10), F.lit("-"), F.substring(plain, 11, 2), F.lit("-"), F.substr(plain, F.lit(13)), F.lit(".txt"))
    name = F.when(F.coalesce(document, F.lit("")).rlike(r"^$|txt$"), text).otherwise(document)
    return F.concat_ws("/", F.lit(ARCHIVE), cik.cast("string"), plain, name)


def filings(submissions: DataFrame) -> DataFrame:
    """Rows of parallel arrays (form, accession, document, filed, reported) with cik, name, ticker → one row a filing of an annual form."""
    zipped = F.arrays_zip("form", "accession", "document", "filed", "reported")
    rows = submissions.select("cik", "name", F.coalesce("ticker", F.col("cik").cast("string")).alias("ticker"), F.explode(zipped).alias("f"))
    kept = rows.where(F.col("f.form").isin(*FORMS))
    return kept.select("name", "ticker", F.col("f.form").alias("type"), F.col("f.filed").alias("filing_date"), F.col("f.reported").alias("report_date"), accession_url(F.col("cik"), F.col("f.accession"), F.col("f.document")).alias("url"))


_COLUMNS = "struct<form:array<string>,accessionNumber:array<string>,primaryDocument:array<string>,filingDate:array<string>,reportDate:array<string>>"
SUBMISSION = f"struct<name:string,tickers:array<string>,filings:struct<recent:{_COLUMNS},files:array<struct<name:string>>>>"


def _filing_arrays(columns: Column) -> list[Column]:
    return [columns[a].alias(b) for a, b in (("form", "form"), ("accessionNumber", "accession"), ("primaryDocument", "document"), ("filingDate", "filed"), ("reportDate", "reported"))]


def submitted_filings(firms: DataFrame, older: DataFrame) -> DataFrame:
    """Filings of firms (cik, body) from the JSON of their submissions: the recent ones, and those of the older files (file, body) that it names.

    A body that is missing or no JSON adds nothing; a firm without a ticker has its number for one."""
    parsed = firms.select("cik", F.from_json("body", SUBMISSION).alias("s")).where("s IS NOT NULL")
    head = [F.col("cik"), F.col("s.name").alias("name"), F.get("s.tickers", F.lit(0)).alias("ticker")]
    recent = parsed.select(*head, *_filing_arrays(F.col("s.filings.recent")))
    files = parsed.select(*head, F.explode("s.filings.files").alias("f")).withColumn("file", F.col("f.name")).drop("f")
    paged = files.join(older.select("file", F.from_json("body", _COLUMNS).alias("c")).where("c IS NOT NULL"), "file")
    return filings(recent.unionByName(paged.select("cik", "name", "ticker", *_filing_arrays(F.col("c")))))


def of_year(df: DataFrame, year: Column) -> DataFrame:
    return df.where(F.startswith(F.col("report_date"), year.cast("string")))


class OfflinePages(DataSource):
    """Fetched pages as a table (url, body). This reader serves a local folder of files, for tests and replays; a fetching one fits the same place.

    Option: path. FetchedPages (sources/fetch.py) is the fetching one."""

    @classmethod
    def name(cls) -> str:
        return "filigrane_pages"

    def schema(self) -> str:
        return "url string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _FolderReader(self.options["path"])


class _FolderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).iterdir()) if p.is_file()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, Path(partition.value).read_text(errors="replace")
