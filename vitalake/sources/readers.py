"""Readers of raw records: CSV (also compressed), tab-separated maps, JSON lines, globs and folders.

Paths are looked up by the Hadoop file system of the session, so any that Spark can read will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def raw_table(spark: SparkSession, folder: str, name: str, schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    """``name.csv.gz`` or else ``name.csv`` of ``folder``; declared types, so codes keep their zeros.

    A compressed file is one split, so it is dealt out after the scan. Raises
    FileNotFoundError if there is neither.
    """
    base = f"{folder.rstrip('/')}/{name}"
    for end in (".csv.gz", ".csv"):
        if exists(spark, base + end):
            df = spark.read.schema(schema).csv(base + end, header=True, multiLine=False, escape='"')
            df = df.select(*columns) if columns else df
            return df.repartition(spark.sparkContext.defaultParallelism) if end == ".csv.gz" else df
    raise FileNotFoundError(base + ".csv")


#: Raw tables by name: where they lie within a release, and their columns in the order of the file; fixed values.
TABLES = {
    "admissions": ("core", "subject_id bigint, hadm_id bigint, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, ethnicity string"),
    "patients": ("core", "subject_id bigint, gender string, anchor_age int, anchor_year int, anchor_year_group string, dod timestamp_ntz"),
    "diagnoses_icd": ("hosp", "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version int"),
    "d_icd_diagnoses": ("hosp", "icd_code string, icd_version int, long_title string"),
    "labevents": ("hosp", "labevent_id bigint, subject_id bigint, hadm_id bigint, itemid bigint, charttime timestamp_ntz, storetime timestamp_ntz, value string, valuenum double, valueuom string, flag string"),
    "d_labitems": ("hosp", "itemid bigint, label string, category string, loinc_code string"),
    "procedures_icd": ("hosp", "subject_id bigint, hadm_id bigint, seq_num int, icd_code string, icd_version int"),
    "d_icd_procedures": ("hosp", "icd_code string, icd_version int, long_title string"),
    "prescriptions": ("hosp", "subject_id bigint, hadm_id bigint, starttime timestamp_ntz, stoptime timestamp_ntz, ndc string, gsn string, drug string, drug_type string, dose_val_rx string"),
    "icustays": ("icu", "subject_id bigint, hadm_id bigint, stay_id bigint, intime timestamp_ntz, outtime timestamp_ntz, los double"),
}


def named_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of ``TABLES`` in its subfolder; patients also with ``yob``, the year of birth. A ValueError for an unknown name.

    Columns are found by their names in the header, whatever their order; further ones are left out.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    sub, schema = TABLES[name]
    base = f"{folder.rstrip('/')}/{sub}/{name}"
    path = next((base + e for e in (".csv.gz", ".csv") if exists(spark, base + e)), None)
    if path is None:
        raise FileNotFoundError(base + ".csv")
    types = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    raw = spark.read.csv(path, header=True, escape='"', multiLine=False)
    low = {c.lower(): c for c in raw.columns}
    df = raw.select(*[(F.col(f"`{low[c]}`").try_cast(t) if c in low else F.lit(None).cast(t)).alias(c) for c, t in types.items()])
    if path.endswith(".gz"):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.withColumn("yob", F.col("anchor_year") - F.col("anchor_age")) if name == "patients" else df


#: The seven tables of an extraction: raw name, columns, those that are times, those that are stripped; fixed values.
EXTRACTION = {
    "admissions": ("ADMISSIONS", ["SUBJECT_ID", "HADM_ID", "ADMITTIME", "DISCHTIME", "HOSPITAL_EXPIRE_FLAG"], ["ADMITTIME", "DISCHTIME"], []),
    "patients": ("PATIENTS", ["SUBJECT_ID", "GENDER", "DOB", "DOD", "EXPIRE_FLAG"], ["DOB", "DOD"], []),
    "diagnoses": ("DIAGNOSES_ICD", ["SUBJECT_ID", "HADM_ID", "SEQ_NUM", "ICD9_CODE"], [], ["ICD9_CODE"]),
    "procedures": ("PROCEDURES_ICD", ["SUBJECT_ID", "HADM_ID", "SEQ_NUM", "ICD9_CODE"], [], ["ICD9_CODE"]),
    "prescriptions": ("PRESCRIPTIONS", ["SUBJECT_ID", "HADM_ID", "DRUG", "DRUG_TYPE", "FORMULARY_DRUG_CD", "GSN", "NDC"], [], ["DRUG"]),
    "d_icd_diagnoses": ("D_ICD_DIAGNOSES", ["ICD9_CODE", "SHORT_TITLE", "LONG_TITLE"], [], ["ICD9_CODE"]),
    "d_icd_procedures": ("D_ICD_PROCEDURES", ["ICD9_CODE", "SHORT_TITLE", "LONG_TITLE"], [], ["ICD9_CODE"]),
}
_NUMBERS = {"SUBJECT_ID", "HADM_ID", "SEQ_NUM", "HOSPITAL_EXPIRE_FLAG", "EXPIRE_FLAG"}


def extracted(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The seven raw tables by name, with the columns asked for, times as such (what can't be read is null) and codes stripped."""
    out = {}
    for name, (raw, columns, times, stripped) in EXTRACTION.items():
        base = f"{folder.rstrip('/')}/{raw}"
        path = next((base + e for e in (".csv.gz", ".csv") if exists(spark, base + e)), None)
        if path is None:
            raise FileNotFoundError(base + ".csv")
        df = spark.read.csv(path, header=True, escape='"')
        df = df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df
        cells = {c: F.col(c) for c in columns}
        cells |= {c: F.try_to_timestamp(c).cast("timestamp_ntz") for c in times}
        cells |= {c: F.trim(F.col(c)) for c in stripped}
        cells |= {c: F.col(c).try_cast("bigint") for c in columns if c in _NUMBERS}
        out[name] = df.select(*[cells[c].alias(c) for c in columns])
    return out


def notes(spark: SparkSession, folder: str, section: str) -> DataFrame:
    """Notes of a section: ``<section>.csv.gz`` or ``.csv``, whose texts may hold line ends and quotes."""
    base = f"{folder.rstrip('/')}/{section.lower()}"
    for end in (".csv.gz", ".csv"):
        if exists(spark, base + end):
            return spark.read.csv(base + end, header=True, multiLine=True, escape='"')
    raise FileNotFoundError(base + ".csv")


def tab_map(spark: SparkSession, path: str, schema: StructType | str, lower: list[str] = (), encoding: str = "ISO-8859-1") -> DataFrame:
    """A tab-separated map with ``ordinal``, its line's order; columns ``lower`` in lower case, null as ''."""
    df = spark.read.schema(schema).csv(path, header=True, sep="\t", encoding=encoding)
    return df.withColumns({c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in lower}).withColumn("ordinal", F.monotonically_increasing_id())


def glob_tables(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """All CSV files of ``pattern`` as one table without repeated rows."""
    return spark.read.schema(schema).csv(pattern, header=True).distinct()


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON lines file or folder."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def json_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All JSON files below ``folder``: ``path`` and ``value``, the whole text of each."""
    return spark.read.text(folder, recursiveFileLookup=True, pathGlobFilter="*.json", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )


def json_consolidated(spark: SparkSession, folder: str, plain: str = "raw_llm_responses") -> DataFrame:
    """All JSON files below ``folder`` as lines: ``path`` (relative), ``line``, in order of the path when written by ``sinks.write_lines``.

    A file right below a folder of ``plain`` is its own line; any other is wrapped: ``__artifact__``, its path, and ``json``.
    A file that isn't JSON gives null as its line.
    """
    files = json_folder(spark, folder)
    root = "/" + folder.split("://")[-1].strip("/") + "/"
    path = F.substring_index(F.url_decode(F.regexp_replace("path", r"^\w+:/+", "/")), root, -1)
    compact = F.to_json(F.try_parse_json("value"))
    named = F.regexp_extract(F.to_json(F.struct(F.col("rel").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    line = F.when(F.col("rel").rlike(f"^{plain}/[^/]+/[^/]+$"), compact).when(
        compact.isNotNull(), F.concat(F.lit('{"__artifact__":'), named, F.lit(',"json":'), compact, F.lit("}"))
    )
    return files.withColumn("rel", path).select(F.col("rel").alias("path"), line.alias("line"))


def binary_by_id(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files below ``folder`` by the id that is their name: ``id``, ``path``, ``length``, ``content``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return df.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "path", "length", "content")


def found_files(spark: SparkSession, ids: DataFrame, key: str, folder: str, ends: Sequence[str] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """``ids`` with ``path``, the file of each id below ``folder``: the id with the first of ``ends`` there is, else the first name that begins with it.

    Names are compared without case where they only begin with the id; an id without a file has a null path. Ids are as long as they
    may be: names are matched to them by equal lengths, so no pairs of all with all are made.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").withColumn("name", F.element_at(F.split("path", "/"), -1))
    wanted = ids.select(F.col(key).cast("string").alias("__id")).where(F.col("__id").isNotNull()).distinct()
    exact = F.explode(F.array(*[F.struct(F.concat("__id", F.lit(e)).alias("name"), F.lit(i).alias("rank")) for i, e in enumerate(ends)]))
    first = wanted.select("__id", exact.alias("x")).select("__id", "x.*").join(names, "name").select("__id", "rank", "name", "path")
    lengths = wanted.select(F.length("__id").alias("n")).distinct()  # a few
    begins = names.join(F.broadcast(lengths), F.length("name") >= F.col("n")).select(F.lower(F.left("name", F.col("n"))).alias("low"), "name", "path")
    second = wanted.withColumn("low", F.lower("__id")).join(begins, "low").select("__id", F.lit(len(ends)).alias("rank"), "name", "path")
    best = first.unionByName(second).groupBy("__id").agg(F.min_by("path", F.struct("rank", "name", "path")).alias("path"))
    return ids.join(best, ids[key].cast("string") == F.col("__id"), "left").drop("__id")


def profile(df: DataFrame) -> DataFrame:
    """Rows, columns, and nulls of each column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns])
    return counts.select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col("rows") - F.col(c)).alias("nulls")) for c in df.columns])).alias("x"),
    ).select("rows", "columns", "x.*")


def mentions(files: DataFrame, needle: str, path: str = "path", text: str = "value") -> DataFrame:
    """Files whose path or text holds ``needle``, whatever its case."""
    low = needle.lower()
    return files.where(F.lower(path).contains(low) | F.lower(F.coalesce(F.col(text), F.lit(""))).contains(low))
