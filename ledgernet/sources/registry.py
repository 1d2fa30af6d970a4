"""The company registry: delimited text, plain or zipped, to Parquet."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.sources.zipped import ENCODING, SEPARATOR, ArchiveSource

# Columns of the registry tables and the source names they come from.
COMPANIES = {
    "cnpj": ["cnpj"],
    "razao_social": ["razaosocial", "razao_social"],
    "capital_social": ["capital_social", "capital_social_da_empresa"],
    "situacao_cadastral": ["situacao_cadastral"],
    "data_situacao_cadastral": ["data_situacao_cadastral"],
}
ESTABLISHMENTS = {
    "cnpj": ["cnpj", "cnpj_basico"],
    "cnpj_ordem": ["cnpj_ordem"],
    "cnpj_dv": ["cnpj_dv"],
    "nome_fantasia": ["nome_fantasia"],
    "cnae_principal": ["cnae_fiscal"],
    "cnaes_secundarios": ["cnae_fiscal_secundaria"],
    "data_inicio_atividade": ["data_inicio_atividade"],
    "situacao_cadastral": ["situacao_cadastral"],
}
PARTNERS = {
    "cnpj": ["cnpj", "cnpj_basico"],
    "nome_socio": ["nome_socio"],
    "qualificacao_socio": ["qualificacao_socio"],
    "pais": ["pais"],
}
# Table name, file name pattern, columns.
TABLES = {
    "empresas": ("Empresas*.zip", COMPANIES),
    "estabelecimentos": ("Estabelecimentos*.zip", ESTABLISHMENTS),
    "socios": ("Socios*.zip", PARTNERS),
}


def table_schema(columns: dict[str, list[str]]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])


def scan_registry(
    spark: SparkSession, path: str, columns: dict[str, list[str]], line_breaks: bool = False
) -> DataFrame:
    """A registry table from plain delimited files: all text, header names in any case.

    Quotes inside quoted text are doubled; a backslash is an ordinary character. With
    ``line_breaks`` quoted text may hold line breaks; a file then does not split, so the
    table should be many files.
    """
    quoting = {"quote": '"', "escape": '"', "multiLine": line_breaks}
    raw = spark.read.options(sep=SEPARATOR, encoding=ENCODING, header=True, **quoting).csv(path)
    present = {name.lower(): name for name in raw.columns}
    picked = []
    for target, sources in columns.items():
        # The target's own name counts too, for files that are renamed already.
        found = [F.col(f"`{present[s]}`") for s in [*sources, target] if s in present]
        picked.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(target))
    return raw.select(*picked)


def archives(spark: SparkSession, pattern: str) -> list[str]:
    """The files that match a path with wildcards, as Spark's file system lists them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return sorted(f.getPath().toString() for f in found or [] if f.isFile())


def scan_zipped_registry(spark: SparkSession, path: str, columns: dict[str, list[str]]) -> DataFrame:
    """A registry table from zip archives, of which the first member is read.

    Zip does not split: an archive is one partition, whose task opens the file and streams
    it in Arrow batches. Archives have to be where workers can open files, a mounted folder
    or a store that Arrow knows. Without any archive the table is empty.
    """
    spark.dataSource.register(ArchiveSource)
    options = {"uris": json.dumps(archives(spark, path)), "columns": json.dumps(columns)}
    return spark.read.format(ArchiveSource.name()).schema(table_schema(columns)).options(**options).load()


def write_zipped(rows: DataFrame, folder: str, prefix: str) -> None:
    """Rows as zip archives of delimited text, named ``prefix`` and a number, one per task that has rows."""
    rows.sparkSession.dataSource.register(ArchiveSource)
    rows.write.format(ArchiveSource.name()).mode("append").option("prefix", prefix).save(folder)


def convert_registry(spark: SparkSession, raw_dir: str, out_dir: str) -> None:
    """Convert the archives of all three tables; a table without archives is left out."""
    for name, (pattern, columns) in TABLES.items():
        if archives(spark, f"{raw_dir}/{pattern}"):
            table = scan_zipped_registry(spark, f"{raw_dir}/{pattern}", columns)
            table.write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")


def _is_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_registry(spark: SparkSession, base_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies and establishments; both empty if either table is missing."""
    names = ("empresas", "estabelecimentos")
    try:
        return tuple(
            spark.read.schema(table_schema(TABLES[n][1])).parquet(f"{base_dir}/{n}.parquet") for n in names
        )
    except AnalysisException as error:
        if not _is_missing(error):
            raise
        return tuple(spark.createDataFrame([], table_schema(TABLES[n][1])) for n in names)
